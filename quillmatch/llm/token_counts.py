"""Token counts from a table of distinct pre-tokens.

Method: the pieces of a pre-token do not depend on what stands around it. Each block of rows is turned into
per-document word frequencies; words unseen so far are cut into pre-tokens, and the pieces of each distinct pre-token
are counted once, without its ids being made. Frequencies are then joined to that table and summed.

The table belongs to a task and holds about twice ``table_bytes`` at most: beyond the limit a new generation begins, into which
words move from the old one as they occur again; words of over ``LONG`` characters never enter it. That changes the cost and not the counts. A table for the whole corpus would have to be joined to one row per document and distinct
pre-token, which is more bytes than the texts themselves; a task's own table needs no exchange at all, so a lost
executor costs its running tasks only.

The premises (words at white space are independent, ``ASCII_RULE`` is the tokenizer's rule for printable ASCII) are tried on ``PROBES`` when a
tokenizer is loaded; one for which they don't hold gets whole texts or whole words instead.

Cases: null text counts as empty (0 bytes, 0 tokens); empty tables give empty results; repeated rows stay; a column
of ``df`` with the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.rows import map_blocks, texts

#: Pre-tokens of printable lower-case ASCII words under the split rule of the tokenizer; other words go to the library.
ASCII_RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Characters of the longest word in the table; bytes that an entry takes besides its characters; bytes of a generation.
LONG, ENTRY, TABLE_BYTES = 64, 220, 40 << 20
#: Characters that str.split() takes for white space and the tokenizer's rule does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Unicode's White_Space, for texts that have one of the odd ones.
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Words that tell rules apart: every printable ASCII character alone, doubled, and between letters and digits, and contractions.
PROBES = [p for c in map(chr, range(33, 127)) for p in (c, c + c, f"a{c}b", f"1{c}2", f"{c}a{c}", f"A{c}1")] + ["don't", "WE'LL", "it's,", "I'd've", "x're2", "('m)", "a'sb", "12ab34", "...--", "'S", "'ll'"]


class PieceTable:
    """Pieces of each distinct word, counted through distinct pre-tokens. ``words`` maps a word to its count; ``old`` is the generation before."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.limit, self.size = limit, 0
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.specials = set(special)
        self.ascii_rule, self.by_words = True, True
        try:
            self.ascii_rule = all(self.pretokens(p) == self.library_pretokens(p) for p in PROBES)
            probes = [*PROBES, *special, *(f"a{s} b" for s in special), "  two  words\n\tand\xa0more\u3000. ", "Ünï ﬁ Σ"]
            self.by_words = not any(WHITE.search(s) for s in special) and all(self.count(p) == self.of_text(p) for p in [" ".join(probes), "\n".join(probes), *probes])
        except (AttributeError, TypeError):  # no normalizer or pre-tokenizer to ask
            self.by_words = False

    def of_text(self, text: str) -> int:
        """The library's count."""
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def library_pretokens(self, word: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def pretokens(self, word: str) -> list[str]:
        if self.ascii_rule and word.isascii() and word.isprintable():
            return ASCII_RULE.findall(word.lower())
        return self.library_pretokens(word)

    def of_pretoken(self, pretoken: str) -> int:
        n = self.pieces.get(pretoken)
        if n is None:
            n = len(self.tokenize(pretoken))
            if len(pretoken) <= LONG:
                self.pieces[pretoken] = n
                self.size += ENTRY + len(pretoken)
        return n

    def of_word(self, word: str) -> int:
        if self.special is None or not self.special.search(word):
            return sum(map(self.of_pretoken, self.pretokens(word)))
        return sum(1 if part in self.specials else sum(map(self.of_pretoken, self.pretokens(part))) for part in self.special.split(word) if part)

    def count(self, text: str) -> int:
        if not self.by_words:
            return self.of_text(text)
        words = Counter(WHITE.split(text) if ODD_SPACE.search(text) else text.split())
        words.pop("", None)
        table, long = self.words, 0
        for word in [w for w in words if w not in table]:
            if len(word) > LONG:
                long += words.pop(word) * self.of_word(word)
                continue
            n = self.old.get(word)
            table[word] = self.of_word(word) if n is None else n
            self.size += ENTRY + len(word)
        total = long + sum(map(int.__mul__, words.values(), map(table.__getitem__, words)))
        if self.size > self.limit:
            self.old, self.words, self.pieces, self.size = table, {}, {}, 0
        return total


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens to each row of ``df``; ``tokenizer`` is the path of a tokenizers .json file. Special strings inside texts count as one token each,
    as the library has it."""

    def make():
        table = PieceTable(tokenizer, table_bytes)
        return lambda block: [[table.count(t) for t in texts(block, text)]]

    counted = map_blocks(df, make, "n_tokens long")
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long"))


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
