"""Operator 10: benchmark decontamination by a generalised suffix automaton of the test items.

The items' words go into one automaton over word sequences. Each document's words then stream through
it; the automaton's state and length say how long the longest run of words ending here is that some item
holds. A run of ``window`` words or more is hit as a whole (each window inside it is an item's), and the
ancestor of the state that holds the run's last ``window`` words says which items. An item of fewer words
is one window; its own state says where it ends. Per document the operator gives the hit spans; it can
cut spans out of the text, or drop the documents whose hits exceed a share of their words.

The automaton is built from the benchmark alone and is broadcast only up to ``MAX_AUTOMATON_BYTES`` of
item text, measured before anything is collected. Beyond that the items are dealt into blocks by hash, of
which the driver holds one at a time; the texts pass each block, what is hit (text hash, spans, items) is
written, and the blocks' spans are merged by the text's hash, so the result is the same.

Edge cases: a null or wordless text has no words, no hits and is not contaminated; items without words
add nothing; an item without an id is hit like any other, under the empty id; repeated items count once;
repeated documents each give a row; other columns are not read (``drop_contaminated`` keeps them as they
are); empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import cut_lineage, filter_batches, per_batch

#: Item text, in bytes, of one automaton: about 200,000 words, and some 150 MB as Python holds it.
MAX_AUTOMATON_BYTES = 1 << 20

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b in _WORD or 0x41 <= b <= 0x5A) else 0x20 for b in range(256))
_WORD_RE = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z in lower case, then runs of digits, a-z and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of word sequences, with the items of each ``window``-word state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def clone(p: int, q: int, w: int) -> int:
            go.append(dict(go[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            copy = len(go) - 1
            while p >= 0 and go[p].get(w) == q:
                go[p][w] = copy
                p = link[p]
            link[q] = copy
            return copy

        for seq in ids:
            last = 0
            for w in seq:
                p = last
                if (q := go[p].get(w)) is not None:
                    last = q if length[q] == length[p] + 1 else clone(p, q, w)
                    continue
                go.append({})
                link.append(0)
                length.append(length[p] + 1)
                last = len(go) - 1
                while p >= 0 and w not in go[p]:
                    go[p][w] = last
                    p = link[p]
                if p >= 0:
                    q = go[p][w]
                    link[last] = q if length[q] == length[p] + 1 else clone(p, q, w)
        self.go, self.link, self.length = go, link, length

        def holder(state: int, n: int) -> int:
            """The state of the last ``n`` words of what leads to ``state``."""
            while length[link[state]] >= n:
                state = link[state]
            return state

        self.window_items: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for (item, _), seq in zip(items, ids, strict=True):
            state = 0
            for k, w in enumerate(seq):
                state = go[state][w]
                if k + 1 >= window:
                    self.window_items.setdefault(holder(state, window), set()).add(item)
            if seq and len(seq) < window:
                own.setdefault(holder(state, len(seq)), []).append((len(seq), item))
        #: For each state: that of its last ``window`` words, and the short items that end with it.
        self.anchor = [holder(s, window) if s and length[s] >= window else 0 for s in range(len(go))]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for s in sorted(range(1, len(go)), key=length.__getitem__):
            if found := own.get(s, []) + self.short.get(link[s], []):
                self.short[s] = found

    def match(self, doc: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans of word positions (end exclusive; merged where they touch), and the items."""
        go, link, length, window, short, anchor = self.go, self.link, self.length, self.window, self.short, self.anchor
        spans: list[list[int]] = []
        items: set[str] = set()
        state = n = 0
        for end, w in enumerate(map(self.vocabulary.get, doc), 1):
            if w is None:
                state = n = 0
                continue
            while state and w not in go[state]:
                state = link[state]
                n = length[state]
            state = go[state][w]  # the root knows every word of the vocabulary
            n += 1
            if n >= window:
                items |= self.window_items[anchor[state]]
                self._add(spans, end - n, end)
            if state in short:
                for k, item in short[state]:
                    if k <= n:
                        items.add(item)
                        self._add(spans, end - k, end)
        return spans, items

    @staticmethod
    def _add(spans: list[list[int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append([start, end])


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def contaminated(n_hit: int, n_words: int, share: int = 20) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null")


def block_count(items: DataFrame, max_bytes: int) -> int:
    return max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max_bytes))


def automaton_of(items: DataFrame, window: int, block: int = 0, blocks: int = 1) -> Automaton:
    """The automaton of one block of items: at most about the bytes that a block may have are collected."""
    part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
    rows = sorted({(r.item, r.text) for r in part.collect()})
    return Automaton([(i, w) for i, t in rows if (w := words(t))], window)


_SPANS, _ITEMS = T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType())


def _matched(df: DataFrame, automaton: Automaton, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` with n_words, spans and items by one automaton."""
    shared = df.sparkSession.sparkContext.broadcast(automaton)

    def make():
        automaton = shared.value

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            counts, spans, items = [], [], []
            for t in batch.column(text_col).to_pylist():
                ws = words(t)
                s, i = automaton.match(ws)
                counts.append(len(ws))
                spans.append(s)
                items.append(sorted(i))
            return {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "items": pa.array(items, pa.list_(pa.string()))}

        return work

    return per_batch(df, make, keep, [("n_words", T.LongType()), ("spans", _SPANS), ("items", _ITEMS)])


def _merged(df: DataFrame, text_col: str, keep: list[str], found: DataFrame) -> DataFrame:
    """``keep`` of ``df`` with n_words, and the spans and items of ``found`` (sha, spans, items: those of all blocks) merged."""
    per = found.groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a block for a text
    empty = F.array().cast("array<array<int>>"), F.array().cast("array<string>")
    joined = df.join(per.withColumnsRenamed({"sha": "__found", "spans": "__spans", "items": "__items"}), F.sha2(df[text_col], 256) == F.col("__found"), "left")
    joined = joined.select(*[df[c] for c in df.columns], F.coalesce("__spans", empty[0]).alias("__spans"), F.coalesce("__items", empty[1]).alias("__items"))

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            spans = [merged(s) for s in batch.column("__spans").to_pylist()]
            return {"n_words": pa.array([len(words(t)) for t in batch.column(text_col).to_pylist()], pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "items": batch.column("__items")}

        return work

    return per_batch(joined, make, keep, [("n_words", T.LongType()), ("spans", _SPANS), ("items", _ITEMS)])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_AUTOMATON_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``keep`` (the id), ``n_words``, ``spans`` (of word positions) and ``items`` (ids as strings)."""
    keep = [id_col] if keep is None else keep
    rows, items = docs.select(*dict.fromkeys([*keep, text_col])), items_of(benchmark, item_col, item_text_col)
    blocks = block_count(items, max_bytes)
    if blocks == 1:
        return _matched(rows, automaton_of(items, window), text_col, keep)
    found, texts = None, docs.select(F.sha2(text_col, 256).alias("sha"), F.col(text_col).alias("text"))
    for block in range(blocks):  # one automaton at a time; what is kept of a block is its hits
        part = _matched(texts, automaton_of(items, window, block, blocks), "text", ["sha"]).where("size(spans) > 0").drop("n_words").dropDuplicates(["sha"])
        part = cut_lineage(part)
        found = part if found is None else found.unionByName(part)
    return _merged(rows, text_col, keep, found)


def summary(found: DataFrame, id_col: str = "doc_id", share: int = 20) -> DataFrame:
    """Of what ``hits`` gives: n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def cut_spans(found: DataFrame, text_col: str = "text", min_words: int = 13, max_share: float = 0.05) -> DataFrame:
    """Of what ``hits`` gives: the rows with spans of ``min_words`` or more cut out of the text.

    A text whose hits exceed ``max_share`` of its words loses all its spans, short items' too.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = []
            for t, n, spans in zip(batch.column(text_col).to_pylist(), batch.column("n_words").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                over = sum(e - s for s, e in spans) > max_share * n
                spans = [x for x in spans if over or x[1] - x[0] >= min_words]
                if spans:
                    raw = t.encode("utf-8", "surrogatepass")
                    at = [m.span() for m in _WORD_RE.finditer(raw.translate(_FOLD))]
                    parts, last = [], 0
                    for s, e in spans:
                        parts.append(raw[last : at[s][0]])
                        last = at[e - 1][1]
                    t = b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")
                out.append(t)
            return {"cut_text": pa.array(out, pa.string())}

        return work

    return per_batch(found, make, [c for c in found.columns if c != text_col], [("cut_text", T.StringType())])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not contaminated.

    With items in one block, in one pass. Otherwise hits must be joined over blocks, so ``hits`` says
    which texts are contaminated, and an anti-join by the text takes them out.
    """
    items = items_of(benchmark, item_col, item_text_col)
    if block_count(items, max_bytes) > 1:
        found = hits(docs.select(F.sha2(text_col, 256).alias("__id"), F.col(text_col).alias("__text")), benchmark, window, "__id", "__text", item_col, item_text_col, max_bytes)
        bad = summary(found, "__id", share).where("contaminated").select(F.col("__id").alias("__bad")).distinct()
        return docs.join(bad, F.sha2(docs[text_col], 256) == bad["__bad"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(items, window))

    def make():
        automaton = shared.value

        def work(batch: pa.RecordBatch) -> list[bool]:
            out = []
            for t in batch.column(text_col).to_pylist():
                ws = words(t)
                out.append(not contaminated(sum(e - s for s, e in automaton.match(ws)[0]), len(ws), share))
            return out

        return work

    return filter_batches(docs, make)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
