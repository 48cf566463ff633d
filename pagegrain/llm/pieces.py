"""SentencePiece encoding and decoding by a table of distinct marked words.

White space becomes the marker U+2581, and no piece of the vocabulary holds another character before a
marker, so a text can be cut before every run of markers; line ends, which no piece of several characters
holds, are cut at too. The chunks between these cuts repeat all over a corpus. Spark counts them, and the
``HOT`` most frequent ones of at most ``HOT_BYTES`` bytes that occur more than once are segmented once
each, into a table that every task gets: its size is bounded whatever the corpus. The long tail, chunks
that hardly ever come back, is segmented where it is met, into a task's own table of at most
twice ``HELD`` chunks: a join would move each of them, and the texts, for a few microseconds of work. Either way the ids
come back to each text in the order of its chunks.

Defined results: a null text is an empty one, and an empty text has the end id only; repeated rows stay
rows; a null id is an id like any other; an empty table gives an empty result; columns other than id and
text are not looked at. Very long texts and chunks are treated like any other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import record, stored

MARKER = "\u2581"
HOT = 1 << 17
HOT_BYTES = 64
HELD = 100_000
ROWS = 256
#: Chunks of a text with a space in front: runs of spaces with the word behind, and line ends with the word behind.
CHUNK = r" +[^ \n]*|\n[^ \n]*"


class Pieces:
    """A model's vocabulary: chunks of texts, ids of chunks, and bytes of ids.

    A chunk is named without its first marker, so a name that begins with a line end has none.
    """

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=model_path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            spec.ParseFromString(file.read())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("the model changes texts before it segments them")
        several = [p.piece for p in spec.pieces if p.type in (1, 4, 5) and len(p.piece) > 1]
        if any(MARKER in piece.lstrip(MARKER) or "\n" in piece for piece in several):
            raise ValueError("pieces cross white space markers or line ends")
        self.marker = self.model.encode("\n")[:1]
        self.end = self.model.eos_id()
        self.cut = re.compile(CHUNK)

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        if MARKER in text:
            text = text.replace(MARKER, " ")
        if "  " in text or text[0] == " ":
            return [c if c[0] == "\n" else c[1:] for c in self.cut.findall(" " + text)]
        return text.replace("\n", " \n").split(" ") if text[0] != "\n" else ["", *text.replace("\n", " \n").split(" ")[1:]]

    def segment(self, chunk: str) -> bytes:
        """Ids of a chunk, 32 bit each. The model puts a marker in front, which a line end is cut from."""
        ids = self.model.encode(chunk)[1:] if chunk[:1] == "\n" else self.model.encode(chunk) if chunk else self.marker
        return np.array(ids, "<u4").tobytes()

    def bytes_of_ids(self) -> list[bytes]:
        """What each id adds to a text, with markers as spaces; nothing for ids of control."""
        out = []
        for at in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(at)
            if self.model.is_control(at) or self.model.is_unused(at):
                out.append(b"")
            elif self.model.is_byte(at):
                out.append(bytes([int(piece[3:-1], 16)]))
            else:
                out.append(piece.replace(MARKER, " ").encode())
        return out


class Segmented(dict):
    """Ids of chunks: those given, and others segmented when first met.

    What is met is held in two generations of a bounded number, so that what comes back often stays.
    """

    def __init__(self, pieces: Pieces, given: dict[str, bytes] | None = None, held: int = HELD):
        super().__init__()
        self.pieces, self.given, self.held, self.before = pieces, given or {}, held, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.given.get(chunk) or self.before.get(chunk) or self.pieces.segment(chunk)
        if len(self) >= self.held:
            self.before = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def raw(self, text: str | None) -> bytes:
        return b"".join([self[c] for c in self.pieces.chunks(text)])

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")


class Gather:
    """Concatenated byte strings of many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings) or b"\0", np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _chunks(text: Column) -> Column:
    """As ``Pieces.chunks``; the texts without runs of spaces are split at single characters."""
    plain = F.replace(text, F.lit(MARKER), F.lit(" "))
    split = F.split(F.replace(plain, F.lit("\n"), F.lit(" \n")), " ")
    found = F.regexp_extract_all(F.concat(F.lit(" "), plain), F.lit(CHUNK), F.lit(0))
    named = F.transform(found, lambda c: F.when(c.startswith("\n"), c).otherwise(F.substring(c, 2, 1 << 30)))
    return F.when(plain.contains("  ") | plain.startswith(" ") | plain.startswith("\n"), named).otherwise(split)


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The chunks with the highest counts, at most ``most``: a cut between powers of 2 ** (1 / 8), without a sort."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    total, cut = 0, None
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 512 rows
        total += row["count"]
        if total > most:
            break
        cut = row["step"]
    return counted.where(F.lit(False) if cut is None else step >= cut)


def chunk_table(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``chunk, n, ids``: the most frequent chunks of the corpus, at most ``HOT``, each segmented once."""
    texts = docs.select(F.col(text).cast("string").alias("text")).where("text != ''")
    counted = texts.select(F.explode(_chunks(F.col("text"))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    counted = stored(counted.where((F.col("n") > 1) & (F.octet_length("chunk") <= HOT_BYTES)), "counted")
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])

    def segment(batches):
        pieces = Pieces(model_path)
        for batch in batches:
            yield record(schema, batch.column(0), batch.column(1), [pieces.segment(c) for c in batch.column(0).to_pylist()])

    return _frequent(counted, HOT).mapInArrow(segment, "chunk string, n long, ids binary")


class Decoder:
    """Texts of lists of ids.

    Pieces and bytes are laid end to end and the marker that encoding put in front is taken away. Lists with
    the unknown id or ids of control inside, or whose bytes are no valid text, are left to the model's decoder.
    """

    def __init__(self, pieces: Pieces):
        self.model, self.gather = pieces.model, Gather(pieces.bytes_of_ids())
        every = range(len(self.gather.sizes))
        self.marked = np.array([self.model.id_to_piece(i).startswith(MARKER) for i in every])
        self.odd = np.array([self.model.is_control(i) or self.model.is_unknown(i) for i in every])

    def __call__(self, ids: np.ndarray) -> str:
        if not self.odd[ids[:-1]].any() and not (ids[-1:] == self.model.unk_id()).any():
            try:
                return self.gather(ids).tobytes().decode()[int(self.marked[ids[:1]].any()) :]
            except UnicodeDecodeError:
                pass
        return self.model.decode(ids.tolist())


def encode(docs: DataFrame, model_path: str, end: bool = True, decoded: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every text, with the end id behind them if asked.

    With ``decoded`` a column of that name holds what the ids give back.
    """
    table = stored(chunk_table(docs, model_path, text), "chunks")
    sent = docs.sparkSession.sparkContext.broadcast({r["chunk"]: bytes(r["ids"]) for r in table.select("chunk", "ids").collect()})
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decoded
    schema = pa.schema(fields)

    def run(batches):
        pieces = Pieces(model_path)
        decoder = Decoder(pieces) if decoded else None
        table, last = Segmented(pieces, sent.value), np.array([pieces.end] if end else [], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [table.raw(value) + last for value in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in out])])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4")))
                yield record(schema, part.column(0), ids, *([[decoder(np.frombuffer(raw, "<i4")) for raw in out]] if decoded else []))

    return _narrow(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; a null list is an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        decoder, none = Decoder(Pieces(model_path)), np.zeros(0, np.int32)
        for batch in batches:
            texts = [decoder(row.values.to_numpy(zero_copy_only=False) if row.is_valid else none) for row in batch.column(1)]
            yield record(schema, batch.column(0), texts)

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
