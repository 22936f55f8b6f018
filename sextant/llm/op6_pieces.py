"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units before each space that follows another character; no
piece reaches over such a cut. The distinct units are concatenated, the suffixes at
character starts are sorted by their first bytes (as many as the longest piece has), and
a binary search of every piece gives its range of occurrences. The occurrences are the
edges of one lattice. Sorted by end position they are relaxed from left to right.

For a model of the byte-pair kind the relaxation keeps, at each position, the one last
piece of the prefix's segmentation: an edge is accepted when its piece and the piece kept
at its start are stable neighbours, that is, when undoing their merges from the latest
never uncovers a merge across the border that comes earlier. So the result equals that
of merging. Characters without a piece become byte pieces. Units that begin with several
spaces, whose pieces have equal scores, are merged directly.

Defined results: null and empty texts have no ids; decoding gives the text back exactly,
except that U+2581, the model's own space mark, becomes a space; repeated rows are
encoded each; other columns are carried through.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, frugal, table
from .words import hashes

#: Bytes of text encoded together, and bytes of distinct units indexed together.
TEXT_BYTES, INDEX_BYTES = 4 << 20, 1 << 18
#: Bytes of a unit that is relaxed on its own, and its characters that are indexed together.
LONG_BYTES, LONG_WINDOW = 4_096, 1 << 16
KNOWN_PAIRS = 300_000  # neighbours whose stability one unit keeps in mind
SPACE, CUT = 0xFF, 0xFE  # bytes that no UTF-8 text holds
NONE = -1


def default_model() -> str:
    """The public byte-pair model among the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A byte-pair SentencePiece model as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        self.id_of: dict[str, int] = {}
        self.score = np.array([sp.get_score(i) for i in range(n)])
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.id_of[name] = i
                self.bytes.append(name.replace("▁", " ").encode())
        # Unknown characters are symbols of their own, numbered after the pieces.
        self.n = n
        order = np.argsort(-self.score, kind="stable")
        self.rank = np.empty(n + 1, np.int64)
        self.rank[order] = np.arange(n)
        self.rank[n] = n  # an unknown character
        self.by_rank = np.append(order, n)
        self.left, self.right = np.full(n + 1, NONE, np.int64), np.full(n + 1, NONE, np.int64)
        pairs: dict[int, int] = {}
        for name, i in self.id_of.items():
            for k in range(1, len(name)):
                a, b = self.id_of.get(name[:k]), self.id_of.get(name[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = self.rank[i]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.whole = np.zeros(n + 1, bool)
        for name, i in self.id_of.items():
            parts = self.merge(name, track := {})
            self.whole[i] = len(parts) == 1
            if len(name) > 1 and self.whole[i]:
                self.left[i], self.right[i] = track[i]
        self.whole[n] = True
        usable = [(name.replace("▁", "\xff").encode("latin-1") if name.strip("▁") == "" else name.replace("▁", "\0").encode().replace(b"\0", b"\xff"), i, len(name)) for name, i in self.id_of.items() if self.whole[i]]
        self.width = max(len(x) for x, _, _ in usable)
        self.keys = np.array([x for x, _, _ in usable], f"S{self.width}")
        self.tops = np.array([x.ljust(self.width, b"\xff") for x, _, _ in usable], f"S{self.width}")
        self.key_ids, self.key_chars = np.array([i for _, i, _ in usable]), np.array([c for _, _, c in usable])
        self.cache_keys, self.cache = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def merge(self, unit: str, track: dict[int, tuple[int, int]] | None = None) -> list[int]:
        """Ids after merging the characters of a unit, best score and then leftmost first."""
        text = list(unit)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(text) and (k := self.id_of.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, text[i], text[j]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if text[i] != a or text[j] != b or after[i] != j:
                continue
            if track is not None:
                track[self.id_of[a + b]] = (self.id_of.get(a, self.n), self.id_of.get(b, self.n))
            text[i], text[j] = a + b, ""
            after[i] = after[j]
            if after[i] < len(text):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for part in text:
            if part:
                i = self.id_of.get(part)
                out += [i] if i is not None else self.byte_ids[list(part.encode())].tolist()
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay neighbours when their characters are merged together."""
        key = a * (self.n + 1) + b
        slot = (key * 0x9E3779B1 >> 7) & (len(self.cache) - 1)
        out = self.cache[slot]
        miss = self.cache_keys[slot] != key
        if miss.any():
            new, where = np.unique(key[miss], return_inverse=True)
            value = self._stable(new // (self.n + 1), new % (self.n + 1))
            out[miss] = value[where]
            at = (new * 0x9E3779B1 >> 7) & (len(self.cache) - 1)
            self.cache_keys[at] = new  # of two that share a slot, numpy keeps the last in both arrays
            self.cache[at] = value
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        rows, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.copy(), b.copy()
        while len(rows):
            key = a * (self.n + 1) + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit)
            out[rows[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            can_a, can_b = self.right[a] != NONE, self.left[b] != NONE
            # Undo the later merge; a merge on the right that comes as late as one on the left was made after it.
            undo_a = can_a & (~can_b | (ra > rb))
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, ra, np.where(undo_b, rb + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            keep = ~bad & (undo_a | undo_b)
            rows, a, b, limit = rows[keep], a[keep], b[keep], limit[keep]
        return out

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """Byte place of every character; first character, piece and characters of every occurrence of a piece.

        ``text`` ends with more cut bytes than the longest piece has. A character without a piece is an edge of its own.
        """
        lead = (text & 0xC0) != 0x80
        lead[text == CUT] = False
        place = np.flatnonzero(lead)
        windows = np.lib.stride_tricks.sliding_window_view(text, self.width)[place]
        suffix = np.ascontiguousarray(windows).view(f"S{self.width}").ravel()
        order = np.argsort(suffix, kind="stable")
        suffix = suffix[order]
        low, high = np.searchsorted(suffix, self.keys, "left"), np.searchsorted(suffix, self.tops, "right")
        n = high - low
        start = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        piece, chars = np.repeat(self.key_ids, n), np.repeat(self.key_chars, n)
        single = np.zeros(len(place), bool)
        single[start[chars == 1]] = True
        unknown = np.flatnonzero(~single)
        return place, np.concatenate((start, unknown)), np.concatenate((piece, np.full(len(unknown), self.n))), np.concatenate((chars, np.ones(len(unknown), np.int64)))

    def encode_long(self, unit: bytes) -> np.ndarray:
        """Ids of one unit: edges of a window at a time, relaxed by their first character."""
        text = np.frombuffer(unit + bytes([CUT]) * (self.width + 1), np.uint8).copy()
        text[text == 0x20] = SPACE
        place = np.flatnonzero(((text & 0xC0) != 0x80) & (text != CUT))
        n, known = len(place), {}
        kept, back = array("i", [NONE]) * n, array("i", [0]) * n
        for a in range(0, n, LONG_WINDOW):
            b, ahead = min(a + LONG_WINDOW, n), min(a + LONG_WINDOW + self.width, n)
            end = place[ahead] if ahead < n else len(unit)
            _, start, piece, chars = self.edges(np.concatenate((text[place[a] : end], np.full(self.width + 1, CUT, np.uint8))))
            order = np.argsort(start, kind="stable")
            order = order[: np.searchsorted(start[order], b - a)]
            first = np.searchsorted(start[order], np.arange(b - a + 1)).tolist()
            piece, chars = piece[order].tolist(), chars[order].tolist()
            for i in range(b - a):
                s = a + i
                before = kept[s - 1] if s else NONE
                if s and before == NONE:
                    continue
                for e in range(first[i], first[i + 1]):
                    p, to = piece[e], s + chars[e] - 1
                    if s:
                        if (good := known.get((before, p))) is None:
                            if len(known) >= KNOWN_PAIRS:
                                known.clear()
                            good = known[before, p] = bool(self.stable(np.array([before]), np.array([p]))[0])
                        if not good:
                            continue
                    if to < n:
                        kept[to], back[to] = p, chars[e]
        out, at = [], n - 1
        while at >= 0:
            p, width = kept[at], back[at]
            if p == self.n:
                out += self.byte_ids[list(unit[place[at] : place[at + 1] if at + 1 < n else len(unit)][::-1])].tolist()
            else:
                out.append(p)
            at -= width
        return np.array(out[::-1], np.int32)

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and the number of ids of each."""
        text = np.frombuffer(bytes([CUT]).join(units) + bytes([CUT]) * (self.width + 1), np.uint8).copy()
        text[text == 0x20] = SPACE
        place, start, piece, chars = self.edges(text)
        cuts = np.flatnonzero(text == CUT)[: len(units)]
        size = np.diff(np.concatenate(([0], np.searchsorted(place, cuts))))
        unit = np.repeat(np.arange(len(units)), size)
        # Parts: characters between positions that no edge crosses, the edges of units among them.
        wide = chars > 1
        inside = np.bincount(start[wide] + 1, minlength=len(place) + 1) - np.bincount(start[wide] + chars[wide], minlength=len(place) + 1)
        begins = np.cumsum(inside)[: len(place)] == 0
        first = np.append(np.flatnonzero(begins), len(place))
        depth = np.arange(len(place)) - first[np.cumsum(begins) - 1]
        end_depth = depth[start] + chars
        by_end = np.argsort(end_depth, kind="stable")
        start, piece, chars, end_depth = start[by_end], piece[by_end], chars[by_end], end_depth[by_end]
        # kept[p]: last piece, and its characters, of the segmentation that ends before character p + 1 of its part.
        kept, back = np.full(len(place), NONE, np.int64), np.zeros(len(place), np.int64)
        for a, b in _slices(end_depth):
            s, p, c = start[a:b], piece[a:b], chars[a:b]
            begins = depth[s] == 0
            good = begins.copy()
            inner = np.flatnonzero(~begins)
            before = kept[s[inner] - 1]
            ok = before != NONE
            inner = inner[ok]
            good[inner] = self.stable(before[ok], p[inner])
            s, p, c = s[good], p[good], c[good]
            kept[s + c - 1], back[s + c - 1] = p, c
        # Walk back from every part's end.
        at, low, found = first[1:] - 1, first[:-1], []
        while len(at):
            found.append((kept[at], at))
            at = at - back[at]
            more = at >= low
            at, low = at[more], low[more]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        ids, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at)
        ids, at = ids[order], at[order]
        rows = unit[at]
        odd = np.flatnonzero(ids == self.n)
        if len(odd):  # unknown characters: their bytes
            ends = np.append(place[1:], len(text))
            width = np.ones(len(ids), np.int64)
            raw = [text[place[p] : ends[p]] for p in at[odd]]
            raw = [r[r != CUT] for r in raw]
            width[odd] = [len(r) for r in raw]
            out = np.repeat(ids, width)
            spread = np.cumsum(width) - width
            for i, r in zip(spread[odd], raw):
                out[i : i + len(r)] = self.byte_ids[r]
            ids, rows = out, np.repeat(rows, width)
        return ids.astype(np.int32), np.bincount(rows, minlength=len(units))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        raw = [b" " + t.replace("▁", " ").encode("utf-8", "replace") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        if not len(data):
            return [np.zeros(0, np.int32) for _ in texts]
        space = data == 0x20
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[edge[:-1][sizes > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        _, one, where = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        joined = data.tobytes()
        units = [joined[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        ids, counts = [], np.zeros(len(units), np.int64)
        spaced = np.array([u[:2] == b"  " for u in units])
        long = np.array([len(u) > LONG_BYTES for u in units]) & ~spaced
        plain = np.flatnonzero(~spaced & ~long)
        weight = np.cumsum([len(units[i]) + 1 for i in plain]) // INDEX_BYTES
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in _slices(weight):
            some = plain[a:b]
            got, n = self.encode_units([units[i] for i in some.tolist()])
            counts[some] = n
            parts.append((some, got, n))
        for i in np.flatnonzero(spaced | long):
            got = self.encode_long(units[i]) if long[i] else np.array(self.merge(units[i].decode().replace(" ", "▁")), np.int32)
            counts[i] = len(got)
            parts.append((np.array([i]), got, np.array([len(got)])))
        offset = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for some, got, n in parts:
            flat[np.repeat(offset[some], n) + np.arange(len(got)) - np.repeat(np.cumsum(n) - n, n)] = got
        n = counts[where]
        total = np.cumsum(n)
        ids = flat[np.repeat(offset[where], n) + np.arange(int(total[-1])) - np.repeat(total - n, n)]
        # ids up to each text's end: the texts' units are whole
        cut = np.concatenate(([0], total))[np.searchsorted(starts, edge)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _slices(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values of a sorted key."""
    if len(key):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])).tolist()
        yield from zip(cut[:-1], cut[1:])


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    """Once per Python worker."""
    return Pieces(path)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The columns of ``docs`` other than text, and tokens (array of int; replaces a column of that name)."""
    keep = [c for c in docs.columns if c not in ("text", "tokens")]
    return _apply(docs, keep, model, "tokens array<int>", lambda tokens, _: [pa.array(tokens, pa.list_(pa.int32()))], ["tokens"])


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """The columns of ``tokens`` other than tokens, and text (replaces a column of that name)."""
    path = model or default_model()
    keep = [c for c in tokens.columns if c not in ("tokens", "text")]
    names = [f"_{i}" for i in range(len(keep))]
    kinds = dict(tokens.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = [None if t is None else pieces.decode(np.array(t, np.int32)) for t in batch.column("_tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    out = tokens.select(*(F.col(c).alias(x) for c, x in zip(keep, names)), F.col("tokens").alias("_tokens"))
    out = out.mapInArrow(frugal(run), ", ".join([*(f"{x} {kinds[c]}" for c, x in zip(keep, names)), "text string"]))
    return out.select(*(F.col(x).alias(c) for c, x in zip(keep, names)), "text")


def _apply(docs: DataFrame, keep: list[str], model: str | None, schema: str, make, added: list[str]) -> DataFrame:
    """``keep`` columns and what ``make(ids per text, texts)`` gives, in Arrow batches."""
    path = model or default_model()
    names, kinds = [f"_{i}" for i in range(len(keep))], dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            for part in chunks(batch, "_text", TEXT_BYTES):
                texts = part.column("_text").to_pylist()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *make(pieces.encode(texts), texts)], names=[*names, *added])

    out = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names)), F.col("text").alias("_text"))
    out = out.mapInArrow(frugal(run), ", ".join([*(f"{x} {kinds[c]}" for c, x in zip(keep, names)), schema]))
    return out.select(*(F.col(x).alias(c) for c, x in zip(keep, names)), *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids, their SHA-256 (as 32-bit little-endian), and whether decoding restores the text."""
    path = default_model()

    def digests(ids: list[np.ndarray], texts: list[str | None]) -> list[pa.Array]:
        pieces = _pieces(path)
        return [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]),
            pa.array([pieces.decode(i) == (t or "") for i, t in zip(ids, texts)]),
        ]

    docs = table(spark, sf_dir, "documents")
    return _apply(docs, ["doc_id"], path, "n_tokens long, ids_sha256 string, restored boolean", digests, ["n_tokens", "ids_sha256", "restored"])
