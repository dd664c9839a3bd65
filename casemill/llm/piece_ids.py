"""SentencePiece ids and their decoding through a table of distinct chunks.

Where no piece crosses from a letter to a white-space marker, a text's segmentation is that of its
chunks (markers and the letters after them) one after the other. A batch's distinct chunks are
segmented once each by the library and its documents are joined from the table by position.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.word_ids import texts_of

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
#: Entries of one generation of a worker's table; two generations are held.
MOST_CHUNKS = 200_000
LONGEST_KEPT = 32

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Marked chunk -> (its ids in decimal, its decoded text), both as bytes."""

    def __init__(self, path: str | None = None) -> None:
        self._model = sentencepiece.SentencePieceProcessor(
            model_file=path or public_tokenizers.path(PIECE_BPE)
        )
        self.check()
        self._ids: dict[str, bytes] = {}
        self._texts: dict[str, bytes] = {}
        self._old: tuple[dict, dict] = ({}, {})
        self._anchor = self._model.encode("a")
        self._lone_mark = [self._model.piece_to_id(MARK)]

    def check(self) -> None:
        """The table holds only for models whose pieces have markers in front and alone."""
        model = self._model
        crossing = re.compile(f"[^{MARK}]{MARK}")
        for k in range(model.get_piece_size()):
            if crossing.search(model.id_to_piece(k)):
                raise ValueError(f"piece {model.id_to_piece(k)!r} crosses a white-space marker")
        if model.normalize("Ａ  ﬁ ") != f"{MARK}Ａ{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("the model's normaliser changes texts")

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text as the model marks it, in chunks that begin with a marker."""
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def fill(self, wanted: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Table with at least the wanted chunks."""
        if len(self._ids) >= MOST_CHUNKS:
            self._old = (self._ids, self._texts)
            self._ids, self._texts = {}, {}
        new = wanted - self._ids.keys()
        for chunk in new & self._old[0].keys():
            self._ids[chunk], self._texts[chunk] = self._old[0][chunk], self._old[1][chunk]
        new = list(new - self._ids.keys())
        # the library puts the first marker before each text itself
        ids = self._model.encode([c[1:] for c in new], num_threads=1)
        ids = [self._lone_mark if c == MARK else i for c, i in zip(new, ids)]
        texts = self._model.decode([self._anchor + i for i in ids], num_threads=1) if new else []
        for chunk, its, text in zip(new, ids, texts):
            self._ids[chunk] = " ".join(map(str, its)).encode()
            self._texts[chunk] = text[1:].encode("utf-8")
        return self._ids, self._texts

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: number of ids with the end id, digest of the ids, digest of the decoded text."""
        end = str(self._model.eos_id()).encode()
        documents = [self.chunks(text or "") for text in texts]
        ids, decoded = self.fill({c for d in documents for c in d})
        out = []
        for document in documents:
            joined = b" ".join([*map(ids.__getitem__, document), end])
            back = b"".join(map(decoded.__getitem__, document))[1:]  # without the first marker
            out.append(
                (
                    joined.count(b" ") + 1,
                    hashlib.sha256(joined).hexdigest(),
                    hashlib.sha256(back).hexdigest(),
                )
            )
        for kept in (self._ids, self._texts):
            for chunk in [c for c in kept if len(c) > LONGEST_KEPT]:
                del kept[chunk]
        return out

    def encode(self, text: str | None) -> list[int]:
        chunks = self.chunks(text or "")
        ids, _ = self.fill(set(chunks))
        return [int(i) for c in chunks for i in ids[c].split()] + [self._model.eos_id()]

    def decode(self, text: str | None) -> str:
        """What the ids of `encode` decode to."""
        chunks = self.chunks(text or "")
        _, texts = self.fill(set(chunks))
        return b"".join(texts[c] for c in chunks)[1:].decode("utf-8")


@functools.cache
def chunk_table(path: str | None = None) -> ChunkTable:
    """The table of this worker process, kept from task to task."""
    return ChunkTable(path)


#: Characters of texts that are put through the table together.
BATCH_CHARACTERS = 2_000_000


def encode_decode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, in no order, no shuffle.

    Null text counts as empty (the end id alone, decoded to nothing). Ids may be null or repeated;
    other columns are not read. No rows: no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)

        def result(ids: list, texts: list) -> pa.RecordBatch:
            counts, tokens, decoded = list(zip(*table.digests(texts))) or ((), (), ())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(tokens, pa.string()),
                    pa.array(decoded, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in texts_of(batch):
                ids.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_CHARACTERS:
                    yield result(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield result(ids, texts)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
