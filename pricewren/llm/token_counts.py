"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of over CHUNK characters is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a position inside
their overlap where both have a token boundary that is proven stable: no piece of the vocabulary holds the two characters around it side by
side, so no merge can ever cross it, and the merges on its two sides don't depend on each other. Where an overlap has no such position, it
is widened, at last over the whole left chunk; where that has none either, the characters up to the next such position (or the end) are encoded once, as a
whole. So time grows with the length, and memory with the longest stretch without a proven boundary. The counts are those of encoding the text in one go, for
a model whose normalisation is `identity`.

Defined results: null and empty texts have 0 tokens; exactly `limit` tokens are not over it; repeated rows are counted each, null ids stay null; no
documents give no rows. Only doc_id and text are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32_768
OVERLAP = 512
SPACE = "▁"


class PieceCounter:
    """Counts the tokens of a sentencepiece model without normalisation rules (`identity`), without begin and end."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        inner: set[str] = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                inner.update(piece[j : j + 2] for j in range(len(piece) - 1))
        self.inner = frozenset(inner)

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.inner

    def begins(self, text: str) -> np.ndarray:
        """The offset of each token's first character."""
        return np.array([begin for begin, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]], dtype=np.int64)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk:
            return len(self.model.encode(text, return_type="numpy"))
        return self._spliced(text)

    def _spliced(self, text: str) -> int:
        total, kept = 0, 0  # tokens before `kept`, a proven boundary, are counted
        left, right = 0, self.chunk  # the current chunk
        begins = self.begins(text[left:right]) + left
        while right < len(text):
            overlap = self.overlap
            while True:
                start = max(kept, right - overlap)
                end = min(len(text), start + self.chunk + overlap)
                after = self.begins(text[start:end]) + start
                both = np.intersect1d(begins[(begins > max(start, kept)) & (begins < right)], after)
                at = next((int(p) for p in both[np.argsort(np.abs(both - (start + right) // 2))] if self.stable(text, int(p))), None)
                if at is not None:
                    total += int(((begins >= kept) & (begins < at)).sum())
                    kept, left, right, begins = at, start, end, after
                    break
                if start == kept:  # nothing in the whole chunk is proven: all up to the next proven boundary is encoded once, as a whole
                    at = next((p for p in range(right, len(text)) if self.stable(text, p)), len(text))
                    left = max(0, kept - 1)
                    total += int((self.begins(text[left:at]) + left >= kept).sum())
                    if at == len(text):
                        return total
                    kept, left = at, at - 1
                    right = min(len(text), left + self.chunk)
                    begins = self.begins(text[left:right]) + left
                    break
                overlap *= 4
        return total + int((begins >= kept).sum())


@lru_cache(maxsize=4)
def _counter(model_path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(model_path, chunk, overlap)


def token_counts(docs: DataFrame, model_path: str, limit: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs(doc_id, text). model_path is a path on each executor."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path, chunk, overlap)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
