"""Repeated passages across documents by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document. A passage repeats where a window's words also
start in a document with a smaller id; the words that such windows cover are the repeated spans.

Suffixes are sampled and dealt out by their first words, each group gets its own small tree:

1. Sampling. Each window has an anchor, the one of its runs of PREFIX words whose hash is least (the leftmost of
   equal ones). Equal windows have equal anchors at the same place, so only suffixes that start at an anchor are
   needed, about one in five, each with the few words before it that windows around the anchor reach back to.
2. Prefixes. The anchors' hashes are counted over all documents, in parts. Suffixes whose prefix is in one document only
   branch off above the depth of a window and are left out. A prefix of more than ``most`` documents gets
   longer: its windows are dealt by all their words. Such prefixes are one in ``most`` of all anchors at most, so their
   hashes can be sent to every task (8 bytes for some 30 MB of text).
3. Dealing. What is left is dealt by prefix, with its words. Each task first settles what repeats within its own
   batch of documents (exactly, on the words) and sends a window's first document only. So a passage that a third of all
   documents holds comes once from each batch.
4. Trees. A part has a tree for each few prefixes. Their windows are read from their anchor on, with the words before the anchor at the end, and sorted by
   their words: with the lengths of the common prefixes of neighbours this is the suffix tree in
   array form. Its internal nodes at the depth of a whole window, with their smallest document, give the repeats; neighbouring
   ones make up one maximal span.

Counts and windows cover whole texts. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null and empty texts have none, and texts
of fewer words than a window have no window. A null id counts as larger than every other; rows of one
id, repeated ones too, don't take words from each other. A window that repeats within its document alone stays.
Very long texts are handled whole: a task needs some thirty bytes for each byte of a piece (4 MB) or of its longest text.
Clashing columns of the input make way for those that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import SPACES, bounded_batches, cut_lineage, text_bytes

#: Words of a window, and of the prefix at its anchor.
WINDOW, PREFIX = 13, 5
#: Bytes of text for each part into which prefixes are dealt.
PART_BYTES = 16 << 20
#: Documents beyond which a prefix fills a part by itself and gets longer.
MOST = 1 << 20
#: Bytes of text that a task works on at once.
PIECE = 4 << 20
#: Windows in a tree, and in what a task holds of them at once; a prefix with more has a larger one.
TREE_WINDOWS = 50_000
#: Stands for a null id.
LAST = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_ID, _HASH = "__id", "__text_hash"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive entries."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + h[j : j + n]
    return _mixed(out)


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive entries, the leftmost of equal ones."""
    place, reached = np.arange(len(h)), 1
    while reached < width:
        step = min(reached, width - reached)
        left, right = place[:-step], place[step:]
        place, reached = np.where(h[right] < h[left], right, left), reached + step
    return place


class Words:
    """The words of a batch of texts. ``norm`` holds them with one space after each; ``codes`` number the distinct ones."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join([*texts, b""])
        data = np.frombuffer(raw, np.uint8)
        space = _SPACE[data]
        after_word = np.zeros(len(data), bool)
        after_word[1:] = ~space[:-1]
        keep = ~space | after_word
        begins = np.flatnonzero(~space & ~after_word)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(offsets, begins, side="right") - 1
        self.norm = data[keep]
        self.norm[space[keep]] = 32
        self.ends = np.flatnonzero(self.norm == 32) + 1  # a word with its space
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each text, its first word

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        return _encoded(self.norm, self.ends)


def _encoded(norm: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words that end at ``ends``, and the distinct words."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(norm))]).dictionary_encode()
    return np.asarray(words.indices, dtype=np.int32), words.dictionary


class Anchored:
    """The windows of a batch of texts, and their runs of one anchor."""

    def __init__(self, words: Words, window: int):
        self.words, n = words, len(words.starts) - window + 1
        self.codes, distinct = words.encoded()
        of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
        self.hashes = of_word[self.codes]
        self.prefixes = _hash_runs(self.hashes, PREFIX)
        if n <= 0:
            self.windows = self.anchors = self.run_first = self.run_size = np.zeros(0, np.int64)
            return
        at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])  # windows within one text
        anchors = _leftmost_least(self.prefixes, window - PREFIX + 1)[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = anchors[1:] != anchors[:-1]
        self.run_first = np.flatnonzero(fresh)
        self.run_size = np.diff(np.append(self.run_first, len(at)))
        self.windows, self.anchors = at, anchors[self.run_first]


def _packed(values: np.ndarray, kind: type) -> bytes:
    return pa.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _slices(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group and the places of its members."""
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(groups[part[0]]), part


def _runs(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of each run of consecutive starts; starts rise within a document."""
    if not len(starts):
        return docs, starts, starts
    fresh = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1] + 1) | (docs[1:] != docs[:-1])))
    last = np.append(fresh[1:], len(starts)) - 1
    return docs[fresh], starts[fresh], starts[last] + 1


#: A row for a part. kind: ASK about prefixes, TELL of prefixes that more documents of a batch have, DONE places and spans that need no
#: other batch, TREES records for the trees, HOT prefixes that fill a part. ids and hashes: of the documents that ``doc``
#: numbers; x, y, z: what each kind has.
ASK, TELL, DONE, TREES, HOT = range(5)
_ROW = "part int, kind int, n_docs int, n int, ids binary, hashes binary, doc binary, x binary, y binary, z binary, words binary, n_bytes int"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _row(part: int, kind: int, keys: np.ndarray, doc: np.ndarray, x: tuple, y: tuple = ((), np.uint8), z: tuple = ((), np.uint8), words: bytes = b"") -> tuple:
    used, doc = np.unique(doc, return_inverse=True) if len(doc) else (doc, doc)
    own = keys[used] if len(used) else np.zeros((0, 2), np.int64)
    return (
        int(part), kind, len(used), len(x[0]), _packed(own[:, 0], np.int64), _packed(own[:, 1], np.int64), _packed(doc, np.uint32), _packed(*x), _packed(*y), _packed(*z),
        pa.compress(words, "zstd", asbytes=True) if words else b"", len(words),
    )


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32() if " int" in c else pa.binary() for c in _ROW.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _keys_of(r: dict) -> np.ndarray:
    return np.stack([_unpacked(r["ids"], r["n_docs"], np.int64), _unpacked(r["hashes"], r["n_docs"], np.int64)], axis=1)


def _texts_and_keys(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts and keys of the distinct rows of a batch, and their places in it."""
    keys = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in (_ID, _HASH)], axis=1)
    _, places = np.unique(keys, axis=0, return_index=True)
    places.sort()
    texts = batch.column("__text").take(pa.array(places)).cast(pa.large_binary()).to_pylist()
    return texts, keys[places], places


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of PIECE bytes of text, or of one text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("__text")).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _prefixes(window: int, parts: int):
    """Batches of texts to rows that ask and tell of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts, keys, _ = _texts_and_keys(batch)
            found = Anchored(Words(texts), window)
            if not len(found.anchors):
                continue
            words, prefix, doc = found.words, found.prefixes[found.anchors], found.words.doc[found.anchors]
            order = np.lexsort((found.anchors, doc, prefix))
            fresh = np.append(True, (prefix[order][1:] != prefix[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
            one = np.sort(order[fresh])  # a prefix of a document once
            prefix, doc, place = prefix[one], doc[one], found.anchors[one] - words.first[doc[one]]
            distinct, back, counts = np.unique(prefix, return_inverse=True, return_counts=True)
            shared = counts[back] > 1
            rows = []
            ask = np.flatnonzero(~shared)
            for part, k in _slices((prefix[ask] % np.uint64(parts)).astype(np.int64)):
                k = ask[k]
                rows.append(_row(part, ASK, keys, doc[k], (place[k], np.uint32), (prefix[k], np.uint64)))
            several = np.flatnonzero(counts > 1)
            for part, k in _slices((distinct[several] % np.uint64(parts)).astype(np.int64)):
                k = several[k]
                rows.append(_row(part, TELL, keys, np.zeros(0, np.int64), (counts[k], np.uint32), (distinct[k], np.uint64)))
            if shared.any():
                k = np.flatnonzero(shared)
                rows.append(_row(int(keys[0].view(np.uint64)[1] % np.uint64(parts)), DONE, keys, doc[k], (place[k], np.uint32)))
            yield _batch_of(rows)

    return run


def _home(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part in which all about a document meets."""
    return (_mixed(keys[:, 1].view(np.uint64) ^ _mixed(keys[:, 0].view(np.uint64))) % np.uint64(parts)).astype(np.int64)


class _Found:
    """Places (of prefixes) or spans of documents, gathered by a task, to be sent to the documents' parts in few rows."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.doc, self.x, self.y, self.n = parts, [], [], [], [], 0

    def add(self, keys: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        self.doc.append(doc.astype(np.int64) + self.n)
        self.x.append(x)
        self.y.append(x if y is None else y)
        self.n += len(keys)

    def rows(self) -> list[tuple]:
        if not self.n:
            return []
        keys, doc, x, y = (np.concatenate(v) for v in (self.keys, self.doc, self.x, self.y))
        return [_row(part, DONE, keys, doc[k], (x[k], np.uint32), (y[k], np.uint32)) for part, k in _slices(_home(keys, self.parts)[doc])]


_OUT = "id long, text_hash long, places array<int>"


def _by_document(each: int):
    """Rows of a part to a row for each of its documents, with ``each`` numbers for an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in batch.to_pylist()]
        if not found:
            return
        before = np.cumsum([0, *(r["n_docs"] for r in found)])
        keys, same = np.unique(np.concatenate([_keys_of(r) for r in found]), axis=0, return_inverse=True)
        doc = same.reshape(-1)[np.concatenate([_unpacked(r["doc"], r["n"], np.uint32).astype(np.int64) + b for r, b in zip(found, before, strict=False)])]
        values = np.stack([np.concatenate([_unpacked(r[c], r["n"], np.uint32) for r in found]) for c in "xy"[:each]], axis=1)
        order = np.argsort(doc, kind="stable")
        used, counts = np.unique(doc, return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(counts * each)]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].reshape(-1).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[used, 0]), pa.array(keys[used, 1]), places], names=["id", "text_hash", "places"])

    return run


def _count_prefixes(most: int, parts: int):
    """Rows of a part to the places of each document's repeated prefixes, and the hashes of those that more than ``most`` documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, told, found = [], [], _Found(parts)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == DONE:
                    found.add(_keys_of(r), _unpacked(r["doc"], r["n"], np.uint32), _unpacked(r["x"], r["n"], np.uint32))
                elif r["kind"] == ASK:
                    asked.append(r)
                else:
                    told.append((_unpacked(r["y"], r["n"], np.uint64), _unpacked(r["x"], r["n"], np.uint32)))
        prefixes = [_unpacked(r.pop("y"), r["n"], np.uint64) for r in asked]
        every = np.concatenate([np.zeros(0, np.uint64), *prefixes, *(p for p, _ in told)])
        weight = np.concatenate([np.zeros(0, np.int64), np.ones(sum(map(len, prefixes)), np.int64), *(c.astype(np.int64) for _, c in told)])
        distinct, back = np.unique(every, return_inverse=True)
        counts = np.bincount(back, weight, len(distinct)).astype(np.int64)
        repeated, at = counts[back] > 1, 0
        for r, p in zip(asked, prefixes, strict=True):
            good = repeated[at : at + len(p)]
            at += len(p)
            if good.any():
                found.add(_keys_of(r), _unpacked(r["doc"], r["n"], np.uint32)[good], _unpacked(r["x"], r["n"], np.uint32)[good])
        rows, hot = found.rows(), distinct[counts > most]
        if len(hot):
            rows.append(_row(0, HOT, np.zeros((0, 2), np.int64), np.zeros(0, np.int64), (hot, np.uint64)))
        yield _batch_of(rows)

    return run


def _first_documents(order: np.ndarray, fresh: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry, the smallest id of its class; ``order`` sorts the classes, ``fresh`` marks where one begins."""
    out = np.empty(len(ids), np.int64)
    starts = np.flatnonzero(fresh)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(ids)))) if len(ids) else ids
    return out


def _suffixes(window: int, parts: int, hot: np.ndarray):
    """Batches of texts with the places of their repeated prefixes to rows for the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts, keys, rows = _texts_and_keys(batch)
            places = batch.column("places").take(pa.array(rows))
            found = Anchored(Words(texts), window)
            words, lengths = found.words, np.asarray(places.value_lengths(), dtype=np.int64)
            if not len(found.anchors):
                continue
            # of a prefix one place in the document is given: mark all its anchors there
            asked_doc = np.repeat(np.arange(len(keys)), lengths)
            asked = np.asarray(places.flatten(), dtype=np.int64) + words.first[asked_doc]
            in_doc = lambda prefix, doc: _mixed(prefix ^ _mixed(doc.astype(np.uint64) + np.uint64(1)))
            wanted = np.isin(in_doc(found.prefixes[found.anchors], words.doc[found.anchors]), in_doc(found.prefixes[asked], asked_doc))
            run_of = np.repeat(np.arange(len(found.anchors)), found.run_size)
            mine = np.flatnonzero(wanted[run_of])
            at, run_of = found.windows[mine], run_of[mine]
            if not len(at):
                continue
            doc = words.doc[at]
            content, ids = _hash_runs(found.hashes, window)[at], keys[doc, 0]
            order = np.argsort(content, kind="stable")
            fresh = np.append(True, content[order][1:] != content[order][:-1])
            same = np.flatnonzero(~fresh)
            one, other = at[order[same]], at[order[same - 1]]
            if any((found.codes[one + j] != found.codes[other + j]).any() for j in range(window)):  # a hash with two contents
                rows_of = found.codes[at[:, None] + np.arange(window)]
                order = np.lexsort(rows_of.T[::-1])
                fresh = np.append(True, (rows_of[order][1:] != rows_of[order][:-1]).any(axis=1))
            done = ids > _first_documents(order, fresh, ids)
            out = []
            if done.any():
                d, s, e = _runs(doc[done], at[done])
                out.append(_row(int(keys[0].view(np.uint64)[1] % np.uint64(parts)), DONE, keys, d, (s - words.first[d], np.uint32), (e - words.first[d], np.uint32)))
            left = np.flatnonzero(~done)
            # one record from the first to the last window of an anchor that is left; a hot prefix has one for each window
            prefix = found.prefixes[found.anchors[run_of[left]]]
            single = np.isin(prefix, hot)
            groups = np.where(single, len(found.anchors) + np.arange(len(left)), run_of[left])
            by_run = np.argsort(groups, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(groups[by_run]) != 0)) if len(left) else by_run
            lasts = np.append(begins[1:], len(left)) - 1 if len(left) else by_run
            head, tail = left[by_run[begins]], left[by_run[lasts]]
            size, start, d = at[tail] - at[head] + 1, at[head], doc[head]
            lead = found.anchors[run_of[head]] - start
            to = np.where(single[by_run[begins]], content[head], prefix[by_run[begins]]) % np.uint64(parts)
            b0, b1 = words.starts[start], words.ends[start + size + window - 2]
            norm = memoryview(words.norm)
            for part, k in _slices(to.astype(np.int64)):
                text = b"".join([norm[x:y] for x, y in zip(b0[k].tolist(), b1[k].tolist(), strict=True)])
                out.append(_row(part, TREES, keys, d[k], (start[k] - words.first[d[k]], np.uint32), (size[k], np.uint8), (lead[k], np.uint8), text))
            yield _batch_of(out)

    return run


def subtree(codes: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of windows (a row of word codes each) in array form: their order, and the length of each one's common prefix with the one before.

    Windows are read from the anchor, ``lead`` words in, to their end and then from their start to the anchor; the
    lead itself comes last. So a common prefix of the whole length plus one is a node of equal windows.
    """
    n, window = codes.shape
    turned = np.take_along_axis(codes, (lead[:, None] + np.arange(window)) % window, axis=1)
    turned = np.concatenate([turned, lead[:, None].astype(turned.dtype)], axis=1)
    order = np.lexsort(turned.T[::-1])
    differs = turned[order][1:] != turned[order][:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), window + 1)
    return order, np.append(0, common) if n else order


def _groups(prefix: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Records whose prefixes are neighbours in order, so many that they have TREE_WINDOWS windows, and each prefix whole."""
    order = np.argsort(prefix, kind="stable")
    last = np.flatnonzero(np.append(prefix[order][1:] != prefix[order][:-1], True))
    windows, at, k = np.cumsum(size[order])[last], 0, 0
    while k < len(last):
        to = max(k + 1, int(np.searchsorted(windows, (windows[k - 1] if k else 0) + TREE_WINDOWS, side="right")))
        yield order[at : last[to - 1] + 1]
        at, k = last[to - 1] + 1, to


def _repeats(codes: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray, lead: np.ndarray, window: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records with their own prefixes, the windows that a smaller document has: the records' names and the windows' places in them."""
    record = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(record)) - np.repeat(np.cumsum(size) - size, size)
    order, common = subtree(codes[(first[record] + within)[:, None] + np.arange(window)], lead[record] - within)
    gone = np.flatnonzero(ids[record] > _first_documents(order, common <= window, ids[record]))
    return names[record[gone]], within[gone]


def _trees(window: int, parts: int):
    """Rows of a part to the spans of windows that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = [], _Found(parts)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == DONE:
                    found.add(_keys_of(r), _unpacked(r["doc"], r["n"], np.uint32), _unpacked(r["x"], r["n"], np.uint32), _unpacked(r["y"], r["n"], np.uint32))
                else:
                    rows.append(r)
        if not rows:
            yield _batch_of(found.rows())
            return
        keys = np.concatenate([_keys_of(r) for r in rows])
        before = np.cumsum([0, *(r["n_docs"] for r in rows)])
        doc = np.concatenate([_unpacked(r["doc"], r["n"], np.uint32).astype(np.int64) + b for r, b in zip(rows, before, strict=False)])
        start, size, lead = (np.concatenate([_unpacked(r[c], r["n"], kind).astype(np.int64) for r in rows]) for c, kind in (("x", np.uint32), ("y", np.uint8), ("z", np.uint8)))
        norm = np.frombuffer(b"".join(pa.decompress(r.pop("words"), r["n_bytes"], "zstd", asbytes=True) for r in rows), np.uint8)
        codes = _encoded(norm, np.flatnonzero(norm == 32) + 1)[0]
        del norm
        first = np.cumsum(size + window - 1) - (size + window - 1)
        prefix = np.zeros(len(first), np.uint64)
        for j in range(PREFIX):
            prefix = _mixed(prefix + codes[first + lead + j].astype(np.uint64))
        gone = [_repeats(codes, keys[doc[k], 0], first[k], size[k], lead[k], window, k) for k in _groups(prefix, size)]
        record, within = (np.concatenate([g[x] for g in gone]) for x in (0, 1))
        d, s = doc[record], start[record] + within
        tidy = np.lexsort((s, d))
        d, s, e = _runs(d[tidy], s[tidy])
        found.add(keys, d, s, e)
        yield _batch_of(found.rows())

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias(_ID), F.xxhash64(text).alias(_HASH), text.alias("__text"))


def _documents(rows: DataFrame, parts: int, each: int) -> DataFrame:
    """All places of a document in one row, which its length bounds; written, so that the join with the texts can split a key's rows."""
    found = rows.repartition(parts, "part").mapInArrow(_by_document(each), _OUT)
    return cut_lineage(found.select(F.col("id").alias(_ID), F.col("text_hash").alias(_HASH), "places"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, most: int = MOST) -> DataFrame:
    """__id, __text_hash, places: for each document with windows that a smaller one has too, (first, last + 1) start of each run of them, in words."""
    if not PREFIX <= window <= 100:
        raise ValueError(f"windows of {PREFIX} to 100 words")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    total = docs.agg(F.sum(text_bytes(F.col(text_col)))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    counted = cut_lineage(keyed.mapInArrow(_prefixes(window, parts), _ROW).repartition(parts, "part").mapInArrow(_count_prefixes(most, parts), _ROW))
    hot = [_unpacked(r.x, r.n, np.uint64) for r in counted.where(F.col("kind") == HOT).select("x", "n").collect()]
    found = _documents(counted.where(F.col("kind") == DONE), parts, 1)
    dealt = keyed.join(found, [_ID, _HASH]).mapInArrow(_suffixes(window, parts, np.concatenate([np.zeros(0, np.uint64), *hot])), _ROW)
    return _documents(dealt.repartition(parts, "part").mapInArrow(_trees(window, parts), _ROW), parts, 2)


def _cut(window: int, keep: list[str], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = batch.column("__text").cast(pa.large_binary()).to_pylist()
            words, places = Words(texts), batch.column("places")
            lengths = np.asarray(places.value_lengths().fill_null(0), dtype=np.int64)
            spans = np.asarray(places.flatten(), dtype=np.int64).reshape(-1, 2)
            base = words.first[np.repeat(np.arange(len(texts)), lengths // 2)]
            depth = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(depth, spans[:, 0] + base, 1)
            np.add.at(depth, spans[:, 1] + base + window - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            sizes = words.ends - words.starts
            kept = words.norm[np.repeat(~gone, sizes)].tobytes()
            n_words = np.diff(words.first)
            n_gone = np.bincount(words.doc[gone], minlength=len(texts))
            ends = np.cumsum(np.bincount(words.doc, np.where(gone, 0, sizes), len(texts)).astype(np.int64))
            cut = [kept[a : max(a, b - 1)] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            doc, start, stop = _runs(words.doc[gone], np.flatnonzero(gone))
            pairs = np.stack([start - words.first[doc], stop - words.first[doc]], axis=1).astype(np.int32).reshape(-1)
            offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            added = [pa.array(n_words), pa.array(n_gone.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs)), pa.array(cut, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, part_bytes: int = PART_BYTES, most: int = MOST) -> DataFrame:
    """``keep`` (default: the id) of each row of ``docs``, n_words, n_removed, ``removed`` (start, stop, start, ... of the spans taken out, in words) and ``kept_text``, the other words joined by one space."""
    found = repeated_windows(docs, window, id_col, text_col, part_bytes, most)
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", T.ArrayType(T.IntegerType())), ("kept_text", T.StringType())]
    taken = {n for n, _ in added}
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added)])
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"__kept_{k}") for k, c in enumerate(keep)], F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias(_ID), F.xxhash64(text).alias(_HASH), text.alias("__text"))
    names = [f"__kept_{k}" for k in range(len(keep))]
    joined = rows.join(found, [_ID, _HASH], "left").select(*names, "__text", "places")
    return joined.mapInArrow(_cut(window, names, schema), schema)
