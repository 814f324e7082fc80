"""Token ids of whole texts, by the ``tokenizers`` library, at corpus speed.

The vocabulary's pre-tokenizer cuts at white space, around each digit, and between
letters and other marks, and the model encodes each such unit on its own. So a batch
of texts is cut into units by array operations (:mod:`rasterloom.llm.bytescan`), and
only units that the worker does not remember go to the library. Its memory is a
table of fixed size from the hash of a unit to its ids in one array; a unit that
falls on a taken place takes it over, and a full array starts anew.

Units are cut here only inside white-space separated chunks of ASCII and Latin-1
letters, digits and marks without an apostrophe; any other chunk goes to the whole
tokenizer. :func:`check_splitting` proves from the vocabulary file that these rules
hold; for any other file every text is encoded in one piece. So is a text with a run
of more than half a megabyte without white space: the library then holds it whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from rasterloom.llm import bytescan
from rasterloom.llm.held import held

#: Closes every document.
END_ID = 1
#: Bits of a place in a worker's memory, ids that it holds, and bytes of the longest unit in it.
PLACE_BITS, ROOM, LONGEST = 20, 6 << 20, 64
#: Bytes of text that are encoded at once, about.
RUN_BYTES = 4 << 20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def check_splitting(path: str) -> bool:
    """True if the file's normalizer and pre-tokenizer cut at white space, and between letters and other marks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    cut = pre[0]
    pattern = cut.get("pattern", {}).get("Regex", "")
    no_gap = cut.get("behavior") == "Removed" and cut.get("invert") is True and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pattern
    last = pre[-1].get("type") == "ByteLevel" and not pre[-1].get("add_prefix_space") and not pre[-1].get("use_regex")
    bare = all(not t["single_word"] and " " not in t["content"] for t in spec["added_tokens"])
    return steps == ["NFC", "Replace", "Lowercase"] and no_gap and last and bare and spec["post_processor"] is None


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_LETTERS = _byte_letters()


def _latin_letters() -> np.ndarray:
    """Second bytes after 0xC3 that make a letter."""
    ok = np.zeros(256, bool)
    ok[0x80:0xC0] = True
    ok[[0x97, 0xB7]] = False
    return ok


_LATIN = _latin_letters()
_KEY = np.uint64(0xD6E8FEB86659FD93)


class Encoder:
    """Encodes Arrow columns of texts; ids are kept as numbers of :attr:`dtype`."""

    def __init__(self, path: str, place_bits: int = PLACE_BITS, room: int = ROOM):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_unit = check_splitting(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self._bpe = self.tokenizer.model.tokenize
        self._shift = np.uint64(64 - place_bits)
        self._keys = np.zeros(1 << place_bits, np.uint64)
        self._at = np.zeros(1 << place_bits, np.int32)
        self._n = np.zeros(1 << place_bits, np.int16)
        self._store = np.empty(room + bytescan.PIECE, self.dtype)
        self._used = 0

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts behind each other, each text closed by :data:`END_ID`; a null is an empty text."""
        n = len(column)
        counts = np.zeros(n, np.int64)
        parts: list[tuple[int, np.ndarray]] = [(-1, np.zeros(0, self.dtype))]
        whole = -1
        for p in bytescan.pieces(column):
            row = int(p.rows[0])
            if row == whole:
                continue
            if p.cut or not self.by_unit:
                # what came of this text's earlier pieces makes way for the text as a whole
                while parts[-1][0] == row:
                    parts.pop()
                for r in p.rows.tolist():
                    ids = self._direct(column[r].as_py() or "")
                    counts[r] = len(ids)
                    parts.append((r, np.array(ids, self.dtype)))
                whole = row if p.cut else -1
                continue
            ids, made = self._units(p)
            counts[p.rows] += made
            parts.append((row, ids))
        ends = np.cumsum(counts + 1)
        flat = np.concatenate([x for _, x in parts])
        out = np.empty(len(flat) + n, self.dtype)
        out[np.arange(len(flat)) + np.repeat(np.arange(n), counts)] = flat
        out[ends - 1] = END_ID
        return out, ends

    def _units(self, p: bytescan.Piece) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a piece, and their number in each segment."""
        if not len(p.starts):
            return np.zeros(0, self.dtype), np.zeros(len(p.rows), np.int64)
        flat, kind = p.flat, p.kind
        # bytes that make a chunk one for the whole tokenizer
        odd = (flat == 0x27) | (flat >= 0x80)
        lead = np.flatnonzero(flat[:-1] == 0xC3)
        lead = lead[_LATIN[flat[lead + 1]]]
        odd[lead] = odd[lead + 1] = False
        mark = np.flatnonzero(flat[:-1] == 0x3C)
        special = mark[flat[mark + 1] == 0x7C]
        odd[special] = True
        odd |= (flat >= 0x1C) & (flat <= 0x1F)
        chunks = np.unique(np.searchsorted(p.starts, np.flatnonzero(odd), "right") - 1)
        begin = np.zeros(len(flat), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == bytescan.DIGIT)
        begin[p.starts] = True
        solid = kind != bytescan.SPACE
        begin &= solid
        for a, b in zip((p.starts[chunks] + 1).tolist(), p.ends[chunks].tolist(), strict=True):
            begin[a:b] = False
        a = np.flatnonzero(begin)
        last = solid.copy()  # a unit ends before the next one, or before white space
        last[:-1] &= begin[1:] | ~solid[1:]
        b = np.flatnonzero(last) + 1
        hashes = p.hashes(a, b)
        whole = np.searchsorted(a, p.starts[chunks])
        hashes[whole] = p.raw_hashes(a[whole], b[whole])
        by_library = np.zeros(len(a), bool)
        by_library[whole] = True
        never = np.zeros(len(a), bool)  # such a unit is encoded each time
        never[np.searchsorted(a, special, "right") - 1] = True
        never |= b - a > LONGEST

        if self._used > len(self._store) - bytescan.PIECE:
            self._keys[:] = 0
            self._used = 0
        keys = hashes * _KEY | np.uint64(1)
        place = (keys >> self._shift).astype(np.int64)
        at, n = self._at[place], self._n[place].astype(np.int32)
        fresh = np.flatnonzero((self._keys[place] != keys) | never)
        more = np.zeros(0, self.dtype)
        if len(fresh):
            # equal units once; one that is never kept stands for itself
            tag = np.where(never[fresh], np.uint64(2) * fresh.astype(np.uint64), keys[fresh])
            _, first, same = np.unique(tag, return_index=True, return_inverse=True)
            new = fresh[first]
            lists = [self._ids(p, x, y, z) for x, y, z in zip(a[new].tolist(), b[new].tolist(), by_library[new].tolist(), strict=True)]
            size = np.array([len(x) for x in lists])
            made = np.fromiter((i for x in lists for i in x), self.dtype, int(size.sum()))
            first_id = np.cumsum(size) - size
            kept = ~never[new]
            if self._used + len(made) <= len(self._store):
                self._store[self._used : self._used + len(made)] = made
                spot = place[new[kept]]
                self._keys[spot], self._at[spot], self._n[spot] = keys[new[kept]], self._used + first_id[kept], size[kept]
                base, self._used = self._used, self._used + len(made)
            else:
                more, base = made, len(self._store)
            at[fresh], n[fresh] = base + first_id[same], size[same]
        ends = np.cumsum(n, dtype=np.int64)
        index = np.repeat(at - (ends - n), n) + np.arange(ends[-1])
        ids = np.concatenate([self._store, more])[index] if len(more) else self._store[index]
        edge = np.append(0, ends)[np.searchsorted(a, p.edges)]
        return ids, np.diff(edge)

    def _ids(self, p: bytescan.Piece, a: int, b: int, by_library: bool) -> list[int]:
        if by_library:
            return self._direct(p.flat[a:b].tobytes().decode("utf-8"))
        unit = p.folded[a:b].tobytes()
        plain = unit.decode() if unit.isascii() else ""
        return [t.id for t in self._bpe(plain if plain.isprintable() and plain else "".join([_LETTERS[x] for x in unit]))]


def id_type(size: int) -> str:
    """The number that holds the ids of a vocabulary of ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def vocabulary_type(path: str) -> str:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(path).get_vocab_size())


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives a task when workers are reused."""
    return held("encoder", path, lambda: Encoder(path))


def runs(column, most: int = RUN_BYTES) -> Iterator[tuple[int, object]]:
    """(first row, slice) of an Arrow string column, each of about ``most`` bytes or one text."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield i, column.slice(i, j - i)
        i = j


def packed_lists(ids: np.ndarray, ends: np.ndarray):
    """The ids of each text as an Arrow binary array, in the bytes of their number type."""
    import pyarrow as pa

    places = np.append(0, ends) * ids.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(ids)])
