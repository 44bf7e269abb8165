"""Problem 1: text statistics of each record, and which records are natural prose.

Every non-blank line gets counts (words, function words, figures, signs), all by
expressions; a hidden Markov model with the states prose, list, table and junk
labels the lines of a record together (Viterbi), and the shares of the labels,
weighted by characters, tell natural prose from the rest. The emissions are
multinomial in the line's counts, so that a long line speaks louder than a short
one. The model begins with set chances and is fitted to the lines of all records
by expectation and maximisation: each round is a pass over their counts, of which
only sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.words import let
from docloom.session import pick, settle, table

STATES = ("prose", "list", "table", "junk")
#: Function words that also join bare noun phrases, as in English headings and lists, and those of Swahili.
JOINING, JOINING_SW = ("and", "for", "of"), ("na", "ya", "wa", "za", "la", "cha")
#: Rounds of fitting.
ROUNDS = 5
#: What the set chances weigh beside the counts of so many records, in tokens and in lines; they weigh more in proportion beside more records.
WEIGHT, BESIDE = 20000.0, 1000
#: White space, and a character that is none.
_GAP = r"[\s\p{Z}\x85]"
_INK = r"[^\s\p{Z}\x85]"
_ODD = r"""[^\p{L}\p{M}\p{N}_\s.,;:!?'"()&/%$\-\u2010-\u201d\u00ad@]|[a-z][A-Z]|[\[\]{}=;]""" + _INK + r"|[\p{L}\p{N}_]\(|[A-Za-z]\d[A-Za-z]"
_BULLET = r"^\s*([-*\u2022\u25cf\u00b7>]|o |\d+[.)] |\(?[a-z]\))"
_TIGHT = r"[,;|](?=[\"\d\-n])(?:(?<!\d[,;|])|(?!\d{3}\b))"
_PUNCT = r"[.!?;:]" + _GAP + "*$"


@dataclass(frozen=True)
class Model:
    """For each component of a state: the chance that a token is a firm function word, an English or a Swahili joining word, a
    figure, a token of signs or broken characters; the chance that its line begins with a bullet; then how states follow each other.
    """

    chances: np.ndarray
    bullets: np.ndarray
    move: np.ndarray
    #: The state of each component: Swahili prose, with few other function words and many joining ones, is one of its own.
    of: tuple[int, ...] = (0, 1, 2, 3, 0)


def _staying(stay: float) -> np.ndarray:
    move = np.full((4, 4), (1 - stay) / 3)
    np.fill_diagonal(move, stay)
    return move


START = Model(
    np.array(
        [
            [0.220, 0.050, 0.003, 0.05, 0.005],
            [0.004, 0.100, 0.004, 0.08, 0.020],
            [0.004, 0.050, 0.003, 0.45, 0.100],
            [0.004, 0.004, 0.004, 0.08, 0.350],
            [0.070, 0.004, 0.140, 0.05, 0.005],
        ]
    ),
    np.array([0.05, 0.20, 0.05, 0.05, 0.05]),
    _staying(0.9),
)


#: In a token: signs before the first letters; a figure has a digit, and at most two letters in their first run; what may be a sign of its own.
_LEAD = r"[^\p{L}\s\p{Z}\x85]*+"
_FIGURE = rf"(?!{_LEAD}\p{{L}}{{3}})(?={_INK}*\d){_INK}++"
_BEGIN = rf"(?<!{_INK})"
_SIGN = r"[^\p{L}\d\s\p{Z}\x85]"
#: Tokens of signs alone, those of one of five signs apart; of these, the three that are no figure.
_SIGNS = rf"(?![a-zA-Z0-9 ]){_SIGN}(?<!{_INK}[\s\S])(?!(?<=[-|&\u2013\u2014])(?!{_INK})){_SIGN}*+(?!{_INK})"
_JOINTS = rf"[&\u2013\u2014](?<!{_INK}[\s\S])(?!{_INK})"
#: A line without anything odd has tokens of these characters only, none of them long, and nothing of what a hint shows.
_PLAIN = rf"""^{_GAP}*+(?:[a-zA-Z0-9_.,;:!?'"()&/%$\-@\p{{L}}\p{{M}}\p{{N}}\u2010-\u201d\u00ad]{{1,24}}+(?:{_GAP}++|$))*+$"""
_HINT = rf"(?=[A-Z\[\]{{}}=;(0-9])(?:[A-Z](?<=[a-z][A-Z])|[\[\]{{}}=;]{_INK}|\((?<=[\p{{L}}\p{{N}}_]\()|\d(?<=[A-Za-z]\d)[A-Za-z])"


def line_counts(text: Column, common: frozenset[str]) -> Column:
    """An array with a struct for each non-blank line: tokens, firm, joining, joining_sw, figures, odd, bullet, chars.

    One expression, in which each pass over a line is made once.
    """
    first = F.lit(rf"{_BEGIN}(?={_INK})(?:{_FIGURE}|{_LEAD}(\p{{L}}*+){_INK}*+)")
    sets = {"firm": sorted(common - set(JOINING) - set(JOINING_SW)) or [" "], "joining": JOINING, "joining_sw": JOINING_SW}
    known = sorted({w for v in sets.values() for w in v})

    def spaced(t: Column) -> Column:
        """In lines of separated values the separators are gaps."""
        return F.when(F.regexp_count(t, F.lit(_TIGHT)) > 1, F.regexp_replace(t, _TIGHT, " ")).otherwise(t)

    def is_odd(token: Column) -> Column:
        """Letters of which the first run is no known word, with something odd in them or of great length."""
        plain = ~token.rlike(rf"^{_FIGURE}") & token.rlike(r"\p{L}")
        return (token.rlike(_ODD) | (F.length(token) > 24)) & plain & ~F.lower(F.regexp_extract(token, rf"^{_LEAD}(\p{{L}}*)", 1)).isin(*known)

    def odd(t: Column) -> Column:
        words = F.size(F.filter(F.regexp_extract_all(t, F.lit(_INK + "+"), F.lit(0)), is_odd))
        return F.when(~t.rlike(_PLAIN) | t.rlike(_HINT), words).otherwise(0)

    def counted(line: Column, t: Column) -> Column:
        def of(words: Column, signs: Column) -> Column:
            def among(members) -> Column:
                return F.size(F.filter(words, lambda w: w.isin(*members)))

            # Tokens without a first run of letters are figures or signs.
            figures = F.size(F.filter(words, lambda w: w == "")) - signs - F.regexp_count(t, F.lit(_JOINTS))
            return F.struct(
                F.size(words).alias("tokens"), *[among(v).alias(k) for k, v in sets.items()], figures.alias("figures"), (odd(t) + signs).alias("odd"),
                line.rlike(_BULLET).cast("int").alias("bullet"),
                F.length(F.btrim(line, F.lit(" \t\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"))).alias("chars"),
            )

        return let(F.regexp_extract_all(F.lower(t), first, F.lit(1)), lambda w: let(F.regexp_count(t, F.lit(_SIGNS)), lambda n: of(w, n)))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda t: t.rlike(_INK))
    return F.transform(lines, lambda line: let(spaced(line), lambda t: counted(line, t)))


COUNTS = ("tokens", "firm", "joining", "joining_sw", "figures", "odd")
#: What a round of fitting sums for each component.
SUMS = (*COUNTS, "bullets", "lines")


def _emissions(counts: np.ndarray, bullets: np.ndarray, model: Model) -> np.ndarray:
    """Log-likelihood of each line (rows: the counts of `COUNTS`) in each component."""
    parts = counts[:, 1:]
    rest = np.maximum(counts[:, :1] - parts.sum(axis=1, keepdims=True), 0)
    out = parts @ np.log(model.chances).T + rest @ np.log(1 - model.chances.sum(axis=1))[None, :]
    return out + np.where(bullets[:, None] > 0, np.log(model.bullets)[None, :], np.log(1 - model.bullets)[None, :])


def by_state(components: np.ndarray, model: Model) -> np.ndarray:
    """Of each state its best component."""
    return np.stack([components[:, [i for i, s in enumerate(model.of) if s == k]].max(axis=1) for k in range(len(STATES))], axis=1)


def label_sums(counts: np.ndarray, bullets: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """For each component the `SUMS` of the lines that the best paths give it."""
    components = _emissions(counts, bullets, model)
    states = viterbi(by_state(components, model), starts, model.move)
    allowed = np.array(model.of)[None, :] == states[:, None]
    one = np.eye(len(model.of))[np.where(allowed, components, -np.inf).argmax(axis=1)]
    return np.column_stack([one.T @ counts, one.T @ (bullets > 0), one.sum(axis=0)])


def refitted(sums: np.ndarray, first: Model, weight: float = WEIGHT) -> Model:
    """The model that the sums of a round give.

    The chances of `first` count as `weight` tokens and lines of each component
    beside those seen, so that a component that the lines hardly have keeps them.
    How states follow each other stays as set: counted, it is that of long records
    of prose, by which a record of two lines of another kind would pass for prose.
    """
    tokens, parts, bullets, lines = sums[:, :1], sums[:, 1 : len(COUNTS)], sums[:, -2], sums[:, -1]
    chances = (parts + weight * first.chances) / (tokens + weight)
    marks = (bullets + weight * first.bullets) / (lines + weight)
    return Model(np.clip(chances, 1e-4, 0.9), np.clip(marks, 1e-3, 0.99), first.move, first.of)


def fit(counts: np.ndarray, bullets: np.ndarray, starts: np.ndarray, model: Model = START, rounds: int = ROUNDS, weight: float = WEIGHT) -> Model:
    """The model after some rounds of labelling the lines by their best path and counting what the labels have."""
    first = model
    for _ in range(rounds if len(counts) else 0):
        model = refitted(label_sums(counts, bullets, starts, model), first, weight)
    return model


def viterbi(emissions: np.ndarray, starts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best states of many sequences at once; `starts` are their first rows, in order.

    The sequences advance together, one line each a step, so the Python loop is
    as long as the longest sequence only.
    """
    k = emissions.shape[1]
    move = np.log(move)
    ends = np.append(starts[1:], len(emissions))
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    score = emissions[starts[order]] - np.log(k)
    back = np.zeros(emissions.shape, dtype=np.int8)
    longest = int(length.max()) if len(length) else 0
    active = np.searchsorted(-length[order], -np.arange(longest), side="left")  # sequences longer than t
    for t in range(1, longest):
        m = active[t]
        rows = starts[order[:m]] + t
        reach = score[:m, :, None] + move[None, :, :]
        back[rows] = reach.argmax(axis=1)
        score[:m] = reach.max(axis=1) + emissions[rows]
    states = np.zeros(len(emissions), dtype=np.int8)
    states[ends[order] - 1] = score.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        m = active[t]
        rows = starts[order[:m]] + t
        states[rows - 1] = back[rows, states[rows]]
    return states


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, bullets and characters of all lines of a batch; for each record with lines its first line, and its row."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    owners = np.flatnonzero(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths[owners])])[:-1].astype(int)
    lines = column.flatten()
    field = {n: np.asarray(lines.field(n), dtype=float) for n in (*COUNTS, "bullet", "chars")}
    return np.stack([field[c] for c in COUNTS], axis=1), field["bullet"], field["chars"], starts, owners


def label(model: Model):
    """The pass over batches of lines' counts, the last column, that gives the share of each label for each record; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bullets, chars, starts, owners = _lines(batch.column(batch.num_columns - 1))
            shares = np.zeros((batch.num_rows, len(STATES)))
            if len(owners):
                states = viterbi(by_state(_emissions(counts, bullets, model), model), starts, model.move)
                of = np.repeat(owners, np.diff(np.append(starts, len(counts))))
                np.add.at(shares, (of, states), chars)
                shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)
            kept = batch.schema.names[:-1]
            columns = batch.columns[:-1] + [pa.array(np.round(shares[:, i], 6)) for i in range(len(STATES))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *[f"{n}_share" for n in STATES]])

    return run


def _common(common_words: DataFrame) -> frozenset[str]:
    """The fixed list of function words, a few hundred rows."""
    return frozenset(r["word"] for r in common_words.where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct().collect())


def _sums(model: Model):
    """The pass over batches of lines' counts, the only column, that gives the sums of a partition for each component, and its records with lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, records = np.zeros((len(model.of), len(SUMS))), 0
        for batch in batches:
            counts, bullets, _, starts, owners = _lines(batch.column(0))
            if len(owners):
                sums += label_sums(counts, bullets, starts, model)
                records += len(owners)
        columns = [pa.array(range(len(sums)), pa.int32()), pa.array([records] * len(sums), pa.int64()), *map(pa.array, sums.T)]
        yield pa.RecordBatch.from_arrays(columns, ["component", "records", *SUMS])

    return run


def fitted(counted: DataFrame, lines: str = "_lines") -> Model:
    """`fit` over the lines of all records: a round is a pass over their counts, and the driver gets one row for each component."""
    model, counted = START, counted.select(lines)
    for _ in range(ROUNDS):
        found = counted.mapInArrow(_sums(model), "component int, records bigint" + "".join(f", {c} double" for c in SUMS))
        rows = sorted(found.groupBy("component").agg(*[F.sum(c).alias(c) for c in ("records", *SUMS)]).collect())
        if not rows or not rows[0]["records"]:
            return START
        model = refitted(np.array([[r[c] for c in SUMS] for r in rows]), START, WEIGHT * max(1, rows[0]["records"] / BESIDE))
    return model


def label_shares(
    docs: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, stats: dict[str, Column] | None = None
) -> DataFrame:
    """`doc_id`, the columns `stats` (of `text`) and the share of the characters of its lines that each label has."""
    common = _common(common_words)
    docs = pick(docs, doc_id=doc_id, text=text)
    counted = docs.select("doc_id", *[c.alias(n) for n, c in (stats or {}).items()], line_counts(F.col("text"), common).alias("_lines"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema.fields[:-1]) + "".join(f", {n}_share double" for n in STATES)
    if model is None:
        # Fitting and labelling both need the counts: written once, the texts are read once.
        counted = settle(counted, "lines")
        model = fitted(counted)
    return counted.mapInArrow(label(model), schema)


def text_statistics(docs: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row of statistics per input row; null, empty and blank texts have zeros throughout.

    `words` are runs of anything but white space, `n_chars` code points, `lines`
    the lines that aren't blank; shares of labels are of characters.
    """
    common, whole = _common(common_words), F.coalesce(F.col("text"), F.lit(""))
    letters = F.regexp_extract_all(F.lower(whole), F.lit(r"\p{L}+"), F.lit(0))
    lines = F.filter(F.split(whole, "\n", -1), lambda t: t.rlike(_INK))

    def share(part: Column, all_: Column) -> Column:
        return F.when(all_ > 0, F.round(part / all_, 6)).otherwise(0.0)

    size = F.length(whole)
    stats = {
        "words": F.regexp_count(whole, F.lit(_INK + "+")).cast("bigint"), "n_chars": size.cast("bigint"), "lines": F.size(lines).cast("bigint"),
        "mean_word_length": let(letters, lambda w: share(F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)), F.size(w))),
        "symbol_ratio": share(F.length(F.regexp_replace(whole, r"[\p{L}\p{N}\s\p{Z}\x85]+", "")), size),
        "punctuated_lines": let(lines, lambda a: share(F.size(F.filter(a, lambda t: t.rlike(_PUNCT))), F.size(a))),
        "common_words": let(letters, lambda w: share(F.size(F.filter(w, lambda x: x.isin(*sorted(common)))), F.size(w))) if common else F.lit(0.0),
    }
    return label_shares(docs, common_words, doc_id, text, model, stats).withColumnRenamed("n_chars", "chars")


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics beside the counts that the metadata states (of the row scraped last by text order of its date)."""
    stats = text_statistics(table(spark, sf_dir, "pdf_results"), table(spark, sf_dir, "common_words"))
    stated = pick(
        table(spark, sf_dir, "doc_metadata"), doc_id="doc_id", scraped="date_scraped", w="word_count", c="char_count"
    ).groupBy("doc_id").agg(F.max_by(F.struct("w", "c"), F.struct("scraped", "w", "c")).alias("s"))
    return stats.join(stated, "doc_id", "left").select(
        *stats.columns, F.col("s.w").alias("stated_words"), F.col("s.c").alias("stated_chars"),
        (F.col("prose_share") >= 0.5).alias("is_prose"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with text of which less than half is labelled prose."""
    shares = label_shares(table(spark, sf_dir, "pdf_results"), table(spark, sf_dir, "common_words"))
    return shares.where("prose_share < 0.5 AND list_share + table_share + junk_share > 0").select("doc_id")


_SQL = r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> ''))::BIGINT AS words,
       length(coalesce(text, ''))::BIGINT AS chars FROM pdf_results"""


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "pdf_results"), table(spark, sf_dir, "common_words")).select("doc_id", "words", "chars")


QUERIES = {"p1_found": p1_found, "p1_statistics": p1_statistics, "p1_counts": p1_counts}
SQL = {"p1_counts": _SQL}
