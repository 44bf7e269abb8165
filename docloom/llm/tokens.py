"""Problem 8: byte-level BPE of a whole corpus with Spark higher-order functions.

The ranks of a public vocabulary file become one literal in the plan: an array
of small maps, addressed by a checksum of the symbol, so that a lookup takes the
same short time however large the vocabulary is. The merges of a word are a fold
over its bytes. Words that occur often are merged once, in a pass over the
distinct words, and become a second literal of bounded size; every other word is
merged where it stands. No text is ever shuffled.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.words import let, most_frequent
from docloom.session import pick, settle, table

TOKENIZER_DIR = os.environ.get("DOCLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-tokenisation pattern of byte-level BPE, with its \s spelt as the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
SLOTS = 16384
NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _slot(key: Column) -> Column:
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _literal(entries: dict[str, object], kind: str) -> Column:
    """A constant array of maps; the optimizer folds the JSON text into one literal."""
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for key, value in entries.items():
        slots[zlib.crc32(key.encode()) & (SLOTS - 1)][key] = value
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), f"array<map<string,{kind}>>")


def _find(constant: Column, key: Column) -> Column:
    return F.element_at(F.get(constant, _slot(key)), key)


class ByteBpe:
    """Encoder for a rank file; symbols are strings with one character per byte."""

    def __init__(self, path: str | None = None, frequent_words: int = 65536):
        self.ranks = read_ranks(path or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
        self.frequent_words = frequent_words
        self._map = _literal({k.decode("latin-1"): v for k, v in self.ranks.items()}, "int")

    def merge(self, word: Column, ranks: Column | None = None) -> Column:
        """Ids of one word: merge the adjacent pair of lowest rank until none has a rank.

        `ranks` is the rank map as a lambda's variable, so that the plan holds the literal once.
        """
        if ranks is None:
            return let(self._map, lambda m: self.merge(word, m))

        def rank(symbol: Column) -> Column:
            return F.coalesce(_find(ranks, symbol), F.lit(NONE))

        def step(acc: Column, _: Column) -> Column:
            s, r = acc["s"], acc["r"]

            def at(p: Column) -> Column:
                def with_new(t: Column) -> Column:
                    left = F.when(p > 1, F.array(rank(F.concat(F.get(s, p - 2), t)))).otherwise(none)
                    right = F.when(
                        p < F.size(r), F.array(rank(F.concat(t, F.get(s, p + 1))))
                    ).otherwise(none)
                    return F.struct(
                        F.concat(F.slice(s, F.lit(1), p - 1), F.array(t), F.slice(s, p + 2, F.size(s))).alias("s"),
                        F.concat(
                            F.slice(r, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(r, p + 2, F.size(s))
                        ).alias("r"),
                    )

                return let(F.concat(F.get(s, p - 1), F.get(s, p)), with_new)

            none = F.array().cast("array<int>")
            lowest = F.array_min(r)
            return F.when(
                F.coalesce(lowest, F.lit(NONE)) < NONE, let(F.array_position(r, lowest).cast("int"), at)
            ).otherwise(acc)

        def fold(symbols: Column) -> Column:
            pairs = F.when(
                F.size(symbols) > 1,
                F.transform(
                    F.sequence(F.lit(1), F.size(symbols) - 1),
                    lambda i: rank(F.concat(F.get(symbols, i - 1), F.get(symbols, i))),
                ),
            ).otherwise(F.array().cast("array<int>"))
            return F.aggregate(
                F.sequence(F.lit(1), F.size(symbols)),
                F.struct(symbols.alias("s"), pairs.alias("r")),
                step,
                lambda acc: F.transform(acc["s"], lambda t: _find(ranks, t)),
            )

        def whole(binary_word: Column) -> Column:
            symbols = F.transform(
                F.sequence(F.lit(1), F.length(binary_word)), lambda i: F.substring(binary_word, i, F.lit(1))
            )
            direct = _find(ranks, binary_word)
            return F.when(direct.isNotNull(), F.array(direct)).otherwise(let(symbols, fold))

        return let(F.decode(word.cast("binary"), "ISO-8859-1"), whole)

    @staticmethod
    def split(text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT), F.lit(0))

    def word_table(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Distinct words of the corpus with their counts (combined before the shuffle)."""
        return (
            docs.select(F.explode(self.split(F.col(text))).alias("word"))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"))
        )

    def frequent(self, docs: DataFrame, text: str = "text") -> Column:
        """The ids of the `frequent_words` most frequent words, as a literal of that bounded size."""
        counts = settle(self.word_table(docs, text).where(F.length("word") <= 64), "words")
        rows = (
            most_frequent(counts, self.frequent_words)
            .repartition(8)
            .select("word", self.merge(F.col("word")).alias("ids"))
            .collect()
        )
        return _literal({r["word"]: r["ids"] for r in rows}, "array<int>")

    def ids(self, text: Column, frequent: Column | None = None) -> Column:
        """Ids of a text; empty and null texts give the empty array."""

        def known(ranks: Column, common: Column | None) -> Column:
            def one(word: Column) -> Column:
                merged = self.merge(word, ranks)
                return merged if common is None else F.coalesce(_find(common, word), merged)

            return F.flatten(F.transform(self.split(text), one))

        if frequent is None:
            return let(self._map, lambda m: known(m, None))
        return let(self._map, lambda m: let(frequent, lambda f: known(m, f)))

    def encode(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """`doc_id, ids`: one row per input row.

        Null and empty texts give the empty array; repeated rows stay repeated;
        further columns of the input are ignored; an empty table gives no rows.
        """
        docs = pick(docs, doc_id=doc_id, text=text)
        return docs.select("doc_id", self.ids(F.col("text"), self.frequent(docs)).alias("ids"))

    def decode(self, rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
        """`doc_id, text`: the binary pieces of the ids, concatenated.

        A null array gives the empty text. Pieces are looked up by id in a literal array.
        """
        pieces: list[str] = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex()
        constant = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        joined = F.array_join(
            F.transform(F.coalesce(F.col("ids"), F.array().cast("array<int>")), lambda i: F.get(constant, i)), ""
        )
        return pick(rows, doc_id=doc_id, ids=ids).select("doc_id", F.decode(F.unhex(joined), "UTF-8").alias("text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ByteBpe().encode(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
