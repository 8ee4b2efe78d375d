"""SentencePiece encoding and decoding through a table of distinct chunks.

Method: no piece of the model has the white-space mark after another character, and none holds a line feed, so the
text falls into chunks (marks and the word after them, runs of line feeds, words after a line feed) that are segmented
independently of each other. Each distinct chunk is segmented once, by the library, and its ids are joined back to every
position of the chunk. Decoding works the same way: what a chunk's ids decode to is found once.

``chunks_are_independent`` proves the premise from the pieces of a model; without it whole texts go to the library. The table belongs
to a task and holds about twice ``table_bytes`` at most: beyond the limit a new generation begins, into which chunks move from the
old one as they occur again. Chunks of over ``LONG`` characters (texts without spaces) never enter it. No exchange is needed.

Cases: null text counts as empty (the end id alone); repeated rows stay; empty tables give empty results; a column of
``df`` with the name of a result column is replaced.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from quillmatch.llm.rows import map_blocks, texts

MARK = "▁"
#: Characters of the longest chunk in the table; bytes that an entry takes besides its characters; bytes of a generation.
LONG, ENTRY, TABLE_BYTES = 64, 250, 40 << 20
CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n+")


def chunks_are_independent(processor) -> bool:
    """Whether no piece has a mark after another character or a line feed, the mark is a dummy prefix, and nothing else is normalised."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not processor.is_control(i) and not processor.is_unknown(i) and not processor.is_byte(i)]
    plain = all("\n" not in p and MARK not in p.lstrip(MARK) for p in pieces)
    probe = "  a \t b ﬁ "
    same = processor.decode(processor.encode(probe)) == probe and processor.id_to_piece(processor.encode("\na")[0]) == MARK
    return plain and same


class ChunkTable:
    """For each distinct chunk its ids, as decimal text; ``odd`` has what a chunk decodes to where that isn't the chunk itself."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.size = limit, 0
        self.ids: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        #: The same two for the long chunks of one text.
        self.long: dict[str, str] = {}
        self.long_odd: dict[str, str] = {}
        self.end = str(p.eos_id())
        self.whole = not chunks_are_independent(p)
        self.feed = p.encode("\n")
        #: What an id adds to the decoded text by itself; None where that takes its neighbours.
        self.piece = [None if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(MARK, " ") for i in range(p.get_piece_size())]

    def chunks(self, text: str) -> list[str]:
        """In order; the first has the dummy prefix."""
        if not text:
            return []
        if self.whole:
            return [" " + text]
        return CHUNK.findall(" " + text.replace(MARK, " "))

    def decoded(self, ids: list[int]) -> str:
        parts = [self.piece[i] for i in ids]
        if None in parts:  # a leading line feed keeps the decoder from taking the first mark for the dummy prefix
            return self.processor.decode([*self.feed, *ids])[1:]
        return "".join(parts)

    def learn(self, chunks: list[str]) -> None:
        """Segments those chunks that aren't in the table, each once."""
        table, old, new = self.ids, self.old, []
        self.long, self.long_odd = {}, {}
        for c in {c for c in chunks if c not in table}:
            if c in old:
                table[c] = old[c]
                self.size += ENTRY + len(c) + len(old[c])
            else:
                new.append(c)
        # The library puts a mark before what it gets; it stands for a chunk's first mark, or comes with a line feed and goes with it.
        got = self.processor.encode([c[1:] if c[0] == " " else "\n" + c for c in new], num_threads=1) if new else []
        for chunk, ids in zip(new, got):
            if chunk == " ":
                ids = self.feed[:-1]  # a mark alone
            elif chunk[0] != " ":
                ids = ids[len(self.feed) :]
            shown, back = " ".join(map(str, ids)), self.decoded(ids)
            if len(chunk) > LONG:
                self.long[chunk] = shown
                if back != chunk:
                    self.long_odd[chunk] = back
                continue
            table[chunk] = shown
            self.size += ENTRY + len(chunk) + len(shown)
            if back != chunk:
                self.odd[chunk] = back

    def turn(self) -> None:
        """A new generation, if the table is full; call it between texts."""
        self.long, self.long_odd = {}, {}
        if self.size > self.limit:
            self.old, self.ids, self.size = self.ids, {}, 0
            self.odd = {c: t for c, t in self.odd.items() if c in self.old}

    def shown(self, chunks: list[str]) -> str:
        parts = map(self.ids.__getitem__, chunks) if not self.long else (self.long[c] if c in self.long else self.ids[c] for c in chunks)
        return " ".join([*filter(None, parts), self.end])

    def encode(self, text: str) -> str:
        """The ids of a text as decimal numbers with spaces between, the end id last."""
        chunks = self.chunks(text)
        self.learn(chunks)
        return self.shown(chunks)

    def round_trip(self, text: str) -> tuple[str, str]:
        """(ids as in encode(), the text that they decode to)."""
        chunks = self.chunks(text)
        self.learn(chunks)
        odd = self.odd | self.long_odd if self.long_odd else self.odd
        return self.shown(chunks), "".join([odd.get(c, c) for c in chunks] if odd else chunks)[1:]  # without the dummy prefix


def encode_pieces(df: DataFrame, model: str, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Adds ids (array<int>, with the end id) and n_tokens."""

    def make():
        table = ChunkTable(model, table_bytes)

        def run(block):
            ids = []
            for t in texts(block, text):
                ids.append([int(i) for i in table.encode(t).split()])
                table.turn()
            return [ids, [len(i) for i in ids]]

        return run

    return map_blocks(df, make, "ids array<int>, n_tokens long")


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from ids; null ids give a null text."""

    def make():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda block: [[None if i is None else processor.decode(i) for i in block.column(block.schema.get_field_index(ids)).to_pylist()]]

    return map_blocks(df, make, f"`{to}` string")


def piece_digests(df: DataFrame, model: str, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 in place of ``text``: encoding and decoding in one pass, so that neither ids nor decoded texts leave the worker."""

    def make():
        table = ChunkTable(model, table_bytes)

        def run(block):
            n, ids, decoded = [], [], []
            for t in texts(block, text):
                shown, back = table.round_trip(t)
                table.turn()
                n.append(shown.count(" ") + 1)
                ids.append(hashlib.sha256(shown.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            return [n, ids, decoded]

        return run

    return map_blocks(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop=[text])


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
