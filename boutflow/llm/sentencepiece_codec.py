"""Operator 1: SentencePiece encoding and decoding by a table of distinct chunks.

In the model no piece holds a white-space marker after another character, so no merge of the BPE joins
what stands on both sides of the start of a run of markers. A text is cut there (and before a run of
line ends or tabs, where the model knows these as single bytes only), each distinct chunk is segmented
once, and ids and decoded text are joined back by the chunk's position. ``Codec`` checks the model for
both properties; a model without them is applied to whole texts.

The table of distinct chunks belongs to a task: it fills while the task goes through its rows and is
emptied at ``MAX_CHUNKS`` entries, which bounds the memory. No row is shuffled.

Edge cases: a null text counts as empty and has the end id alone; repeated rows and repeated ids each
give a row; columns other than the id and the text are not read unless they are to be kept, and one that is
named like an added column makes way for it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from boutflow.llm.common import per_batch, texts

#: Distinct chunks that a task holds at once.
MAX_CHUNKS = 100_000
#: The same where rows are kept whole (``encode_texts``): beside the table, the task then holds texts, ids and decoded texts.
MAX_CHUNKS_WHOLE = 32_768
#: Chunks longer than this are segmented but not held.
MAX_HELD_CHARS = 64
MARKER = "▁"


class Codec:
    """Encodes and decodes whole texts exactly as the library does, through distinct chunks."""

    def __init__(self, model_path: str, max_chunks: int | None = None):
        import sentencepiece

        self.max_chunks = MAX_CHUNKS if max_chunks is None else max_chunks

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.marker_id = self.model.piece_to_id(MARKER)
        self.whole = any(MARKER in p.lstrip(MARKER) for p in pieces) or self.model.encode("a  b ") != [*self.model.encode("a"), *self.model.encode(" b")[0:], self.marker_id]
        inner = {c for p in pieces for c in p}
        lone = "".join(c for c in "\n\t" if c not in inner and len(self.model.encode(c)) == 2)
        self.line_ids = 2 if "\n" in lone else 0
        cut = lone if self.line_ids else ""
        self.chunk = re.compile(rf" +[^ {cut}]*|[{cut}]+[^ {cut}]*" if cut else r" +[^ ]*")
        self.table: dict[str, tuple[str, str]] = {}

    def _segment(self, chunks: list[str]) -> None:
        """Puts the chunks' ids, as text, and decoded text into the table."""
        marked = [c for c in chunks if c[0] == " " and len(c) > 1]
        ids = self.model.encode([c[1:] for c in marked], num_threads=1)
        other = [c for c in chunks if c[0] != " "]
        ids += [x[self.line_ids :] for x in self.model.encode(["\n" + c for c in other], num_threads=1)]
        lone = [c for c in chunks if c == " "]
        ids += [[self.marker_id]] * len(lone)
        # decode() drops one leading space of what it is given, so each chunk is decoded after a marker
        decoded = self.model.decode([[self.marker_id, *x] for x in ids], num_threads=1) if ids else []
        for c, x, d in zip([*marked, *other, *lone], ids, decoded, strict=True):
            self.table[c] = (" ".join(map(str, x)), c if c == d else d)  # mostly equal: held once

    def run(self, text: str) -> tuple[list[str], list[str]]:
        """The text's ids by chunk, as text, and its decoded text by chunk."""
        if not text:
            return [], []
        chunks = self.chunk.findall(" " + text.replace(MARKER, " "))
        table = self.table
        if new := list({c for c in chunks if c not in table}):
            if len(table) + len(new) > self.max_chunks:
                table.clear()
                new = list(set(chunks))
            self._segment(new)
        found = [table[c] for c in chunks]
        for c in new:
            if len(c) > MAX_HELD_CHARS:
                del table[c]
        ids, decoded = [x[0] for x in found], [x[1] for x in found]
        decoded[0] = decoded[0][1:]
        return ids, decoded

    def encode(self, text: str) -> str:
        """Decimal ids with one space between, the end id last."""
        if self.whole:
            return " ".join(map(str, [*self.model.encode(text), self.model.eos_id()]))
        return " ".join([*self.run(text)[0], str(self.model.eos_id())])

    def both(self, text: str) -> tuple[str, str]:
        if self.whole:
            ids = [*self.model.encode(text), self.model.eos_id()]
            return " ".join(map(str, ids)), self.model.decode(ids)
        ids, decoded = self.run(text)
        return " ".join([*ids, str(self.model.eos_id())]), "".join(decoded)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``keep`` (the id column), ``token_ids`` (ints, the end id last) and ``decoded``."""

    def make():
        codec = Codec(model_path, MAX_CHUNKS_WHOLE)

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = [codec.both(t) for t in texts(batch, text_col)]
            return {"token_ids": pa.array([np.fromstring(x, np.int32, sep=" ") for x, _ in out], pa.list_(pa.int32())), "decoded": pa.array([d for _, d in out], pa.string())}

        return work

    keep = [id_col] if keep is None else keep
    return per_batch(docs.select(*dict.fromkeys([*keep, text_col])), make, keep, [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())])


def digest_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``keep`` (the id column), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""

    def make():
        codec = Codec(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            counts, ids, decoded = [], [], []
            for t in texts(batch, text_col):
                x, d = codec.both(t)
                counts.append(x.count(" ") + 1)
                ids.append(sha(x))
                decoded.append(sha(d))
            return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}

        return work

    keep = [id_col] if keep is None else keep
    return per_batch(docs.select(*dict.fromkeys([*keep, text_col])), make, keep, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])
