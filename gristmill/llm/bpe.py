"""Byte-level BPE: encoding by a queue of merge ranks over a doubly linked list of symbols, decoding, token counts.

Texts are first parted at added tokens (their strings inside a text are tokens, as is the library's default), then into
pre-tokens; merges never cross a pre-token.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import regex

#: Fixed values of the byte-level format: its pre-token pattern and the bytes that stand for themselves as characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of Latin-1, whose letters, numbers and spaces need no Unicode tables.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
PRINTABLE = (*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1))
#: Bytes (about) of a worker's cache of encoded units, and those of an entry besides its characters.
CACHE, ENTRY = 48 << 20, 200


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    spare = iter(range(256, 512))
    kept = set(PRINTABLE)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Known(dict):
    """Units and their decimal ids, joined by commas; a unit that isn't there is encoded when it is asked for, unless it was
    among those of `before`, from which it moves."""

    def __init__(self, codec: Codec, before: dict[str, str]):
        self.codec, self.before, self.held = codec, before, 0

    def __missing__(self, unit: str) -> str:
        found = self.before.pop(unit, None)
        if found is None:
            found = ",".join(map(str, self.codec.ids(unit)))
        self[unit] = found
        self.held += ENTRY + 4 * len(unit) + len(found)
        return found


class Codec:
    def __init__(self, spec: str):
        """spec: the tokenizer's JSON text, with a BPE model and byte-level pre-tokens."""
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        # ids of a pair -> (rank, id of the merged symbol)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        chars = byte_characters()
        self.byte_ids = [ids[c] for c in chars]
        to_byte = {c: b for b, c in enumerate(chars)}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.strings: dict[str, bytes] = {str(i): bytes(to_byte[c] for c in s) for s, i in ids.items()}
        self.strings |= {str(i): s.encode() for s, i in self.added.items()}
        self.any_pieces, self.latin_pieces = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        parts = sorted(self.added, key=lambda s: (-len(s), s))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, parts)) + ")").split if parts else None
        self.known = Known(self, {})

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token.

        The queue holds (rank, place of the left symbol, the pair's ids, merged id).  An entry is stale if either symbol
        has changed or gone since; it is skipped when it comes up.
        """
        byte_ids, merges = self.byte_ids, self.merges
        ids = [byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n == 1:
            return ids
        find = merges.get
        queue = []
        for i in range(n - 1):
            a, b = ids[i], ids[i + 1]
            if found := find((a, b)):
                queue.append((found[0], i, a, b, found[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, a, b, merged = pop(queue)
            if ids[i] != a:
                continue
            j = after[i]
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := find((merged, ids[k])):
                    push(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := find((ids[h], merged))):
                push(queue, (found[0], h, ids[h], merged, found[1]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """The text's pre-tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces(text)
        return self.latin_pieces(text)

    def units(self, text: str) -> list[str]:
        """The text's pre-tokens and added tokens in turn: concatenated, they give the text, and no merge crosses two of them."""
        if self.cut is None or not any(map(text.__contains__, self.added)):
            return self.pieces(text)
        out = []
        for k, part in enumerate(self.cut(text)):
            out += [part] if k % 2 else self.pieces(part)
        return out

    def ids(self, unit: str) -> list[int]:
        """Ids of one pre-token or added token."""
        return [self.added[unit]] if unit in self.added else self.merge(unit)

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if self.known.held > CACHE // 2:
            # what is used again moves on, and only the rest goes
            self.known.before = {}
            self.known = Known(self, self.known)
        return ",".join(map(self.known.__getitem__, self.units(text)))

    def forget(self) -> None:
        """Empties the cache."""
        self.known = Known(self, {})

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by commas: vocabulary strings one after the other."""
        return b"".join(map(self.strings.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """One codec for each worker process and tokenizer."""
    return Codec(spec)
