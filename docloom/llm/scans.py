"""Problem 6: repair of text from scanned pages.

Four passes. (1) One scan of the corpus gives its pairs of neighbouring words
with counts, and from them the frequency lexicon. (2) A symmetric-delete index
over the lexicon gives, for each word, far more frequent words close by; a
weighted edit distance judges them, with confusion pairs that are partly fixed
and partly learned from these candidates. (3) The pages of a record stream by in
order; running headers, footers and page numbers are found by what recurs at the
pages' edges, words cut at line ends are joined, and words that aren't surely
right go on with their neighbours. (4) The counts of the pairs that a candidate
would make with these neighbours pick the repair, or speak against it.

All thresholds are shares and ratios, so they mean the same for any corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.words import let
from docloom.session import pick, settle, table

#: A word may hold signs that stand for letters, not at its end if they are punctuation as well.
WORD = r"[\p{L}\p{N}@$|](?:[\p{L}\p{N}@$|!]*[\p{L}\p{N}@$|])?"
#: Characters that scans confuse, each with the one that stands for all of them, and pairs read as one.
ALIKE = ("01l!|5$@9efb6", "oiiiissagcthg")
PAIRS = (("rn", "m"), ("ri", "n"), ("vv", "w"), ("ci", "d"), ("ii", "u"), ("in", "m"))
#: Words of at least this share of all tokens, if they have no correction, are surely right: 1 / SURE words at most.
SURE = 2e-5
#: A correction must be so many times as frequent as the word.
RATIO = 20
#: A confusion is learned if it explains this share of the words with the wrong character that may be misread, and so many words.
LEARN_SHARE, LEARN_WORDS = 0.015, 4
#: Cost of an edit: within a group of confusable characters, of a pair read as one, learned; any other costs 1.
ALIKE_COST, PAIR_COST, LEARNED_COST, FURTHEST = 0.3, 0.4, 0.6, 0.95
#: Folded words up to this length are indexed by their deletes, longer ones by their halves, which finds the same.
DELETES_TO = 32
CUTS = "-¬‐­"
_NUMBER = re.compile(r"^\W*(?:(page|p\.?|ukurasa|uk\.?)\s*)?([\dlIOo]{1,5}|[ivxl]{1,6})(?:\s*(of|/|ya)\s*[\dlIOo]{1,5})?\W*$", re.I)
_FIGURE = re.compile(r"^(?=.*\d)(?=.*[lIOo])[\dlIOo]+$")
_PLAIN = re.compile(r"^[\dlIOo]+$")
_TOKEN = re.compile(r"[^\W_]+(?:[@$|!][^\W_]+)*|[@$|][@$|!]?[^\W_]+(?:[@$|!][^\W_]+)*")


def fold_column(word: Column) -> Column:
    """The word with each confusable character or pair replaced by the one that stands for its group."""
    folded = F.translate(F.lower(word), *ALIKE)
    for pair, one in PAIRS:
        folded = F.replace(folded, F.lit(pair), F.lit(one))
    return folded


def fold(word: str) -> str:
    word = word.lower().translate(str.maketrans(*ALIKE))
    for pair, one in PAIRS:
        word = word.replace(pair, one)
    return word


#: A capitalised word inside a sentence: a name, if its words mostly stand so.
INSIDE = r"\p{Lu}(?<=[\p{Ll}\p{N},] .)\p{Ll}+\b"


def hashed(word: Column) -> Column:
    return F.when(word.isNotNull(), F.xxhash64(word))


def word_pairs(pages: DataFrame) -> DataFrame:
    """`word, after, n, inside`: each lower-case word with a hash of the one after it (null at a page's end) and how often.

    Counts are combined before the shuffle. Rows with `inside` count the word's
    capitalised occurrences within sentences and have no `n`.
    """
    low = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    pairs = let(low, lambda a: F.transform(a, lambda w, i: F.struct(w.alias("word"), hashed(F.get(a, i + 1)).alias("after"), F.lit(1).alias("n"), F.lit(0).alias("inside"))))
    names = F.transform(
        F.regexp_extract_all("text", F.lit(INSIDE), F.lit(0)),
        lambda w: F.struct(F.lower(w).alias("word"), F.lit(None).cast("bigint").alias("after"), F.lit(0).alias("n"), F.lit(1).alias("inside")),
    )
    rows = pages.where("text IS NOT NULL").select(F.explode(F.concat(pairs, names)).alias("r")).select("r.*")
    return rows.groupBy("word", "after").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))


def lexicon(pairs: DataFrame) -> DataFrame:
    """`word, n, name`: counts of words, and whether at least half of them are capitalised within sentences."""
    counts = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).where("n > 0")
    return counts.select("word", "n", (F.col("inside") * 2 >= F.col("n")).alias("name"))


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50}
    total, last = 0, 0
    for c in reversed(text.lower()):
        if c not in values:
            return None
        total += -values[c] if values[c] < last else values[c]
        last = max(last, values[c])
    return total


def page_values(line: str) -> list[tuple[int, bool]]:
    """The numbers that a line may state as its page, with whether it is dressed as a page number."""
    m = _NUMBER.match(line.strip())
    if not m:
        return []
    raw, dressed = m.group(2), bool(m.group(1) or m.group(3) or re.match(r"^\s*[-\[(–—]\s*\w+\s*[-\])–—]\s*$", line))
    out = []
    digits = raw.translate(str.maketrans("lIOo", "1100"))
    if digits.isdigit():
        out.append((int(digits), dressed))
    if roman(raw) is not None:
        out.append((roman(raw), dressed))
    return out


def header_key(line: str) -> str:
    """What recurs of a header: no figures and signs, confusable characters folded."""
    bare = re.sub(r"(\s{2,}[\dlIOo]+|\.\.\.|…)\s*$", "", line.strip())
    return re.sub(r"[^\w]|_", "", fold(bare))


def same_header(a: str, b: str) -> bool:
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) >= 12 and long.startswith(short[:-1]) and len(short) * 4 > len(long):
        return True
    if abs(len(a) - len(b)) > 4 or len(short) < 8:
        return a == b
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85


def header_groups(keys: list[str]) -> list[int]:
    """For each key how many of the keys are the same header, itself included.

    Equal keys are one; each further key is compared only with earlier heads of
    groups that share runs of four characters with it, so that the work grows
    with the pages and not with their pairs.
    """
    if len(keys) < 2:
        return [1] * len(keys)
    heads: list[str] = []
    of: dict[str, int] = {}
    posting: dict[str, list[int]] = {}
    for key in dict.fromkeys(keys):
        # Keys that are alike have many runs in common, so the first ones do, and every second one to look up.
        start = key[:48]
        runs = [start[i : i + 4] for i in range(max(1, len(start) - 3))]
        shared: dict[int, int] = {}
        for run in runs[::2]:
            for h in posting.get(run, ()):
                shared[h] = shared.get(h, 0) + 1
        met = next((h for h, _ in sorted(shared.items(), key=lambda x: -x[1]) if same_header(key, heads[h])), None)
        if met is None:
            met = len(heads)
            heads.append(key)
            for run in set(runs):
                posting.setdefault(run, []).append(met)
        of[key] = met
    size: dict[int, int] = {}
    for key in keys:
        size[of[key]] = size.get(of[key], 0) + 1
    return [size[of[key]] for key in keys]


def furniture(pages: list[list[str]], numbers: list[int], title: str | None) -> set[tuple[int, int]]:
    """`(page index, line index)` of headers, footers and page numbers of one record."""
    out: set[tuple[int, int]] = set()
    edges = []
    for text in pages:
        filled = [i for i, line in enumerate(text) if line.strip()]
        edges.append((filled[:3], filled[-2:]))
    # Page numbers: the difference to the page's place is the same on several pages, or the line says it is one.
    shifts: dict[int, set[int]] = {}
    seen = []
    for p, (top, bottom) in enumerate(edges):
        for i in dict.fromkeys(top[:2] + bottom):
            for value, dressed in page_values(pages[p][i]):
                shifts.setdefault(value - numbers[p], set()).add(p)
                seen.append((p, i, value - numbers[p], dressed))
    best = max((len(s) for s in shifts.values()), default=0)
    for p, i, shift, dressed in seen:
        if dressed or (len(shifts[shift]) == best and best >= 2):
            out.add((p, i))
    # Headers and footers: alike on two pages at least, in the same zone.
    name = header_key(title or "")
    for zone in (0, 1):
        keyed = []
        for p, ends in enumerate(edges):
            rows = [i for i in ends[zone] if (p, i) not in out]
            for i in rows[:1] if zone == 0 else rows[-1:]:
                key = header_key(pages[p][i])
                if len(key) >= 8:
                    keyed.append((p, i, key, pages[p][i]))
        kin = header_groups([key for _, _, key, _ in keyed])
        for (p, i, key, line), twins in zip(keyed, kin):
            named = zone == 0 and numbers[p] > 1 and len(name) >= 12 and (same_header(key, name) or key.endswith(name[:40]))
            barred = zone == 0 and numbers[p] > 1 and re.match(r"^[A-Z][\w &'-]{2,40} \| \S.{8,}$", line.strip())
            if twins > 1 or named or barred:
                out.add((p, i))
    return out


def examine(known: frozenset[str]):
    """The pass over pages sorted by record: rows `doc_id, page_number, line_no, kind, word, other, before, after`.

    `kind` is furniture, cut (`word` joined, `other` with its hyphen), figure, or
    suspect (`word` is not surely right; with its neighbours).
    """

    def record(doc: str, rows: list[tuple[int, str]], title: str | None) -> Iterator[tuple]:
        pages = [(t or "").split("\n") for _, t in rows]
        numbers = [n for n, _ in rows]
        gone = furniture(pages, numbers, title)
        body = []
        for p, text in enumerate(pages):
            for i, line in enumerate(text):
                if (p, i) in gone:
                    yield doc, numbers[p], i + 1, "furniture", None, None, None, None
                elif line.strip():
                    body.append((p, i, line))
        skip = ""
        for k, (p, i, line) in enumerate(body):
            tokens = _TOKEN.findall(line)
            first, last = skip, ""
            skip = ""
            bare = line.rstrip()
            if bare[-1] in CUTS and len(bare) > 2 and bare[-2].isalpha() and k + 1 < len(body) and tokens:
                right = _TOKEN.match(body[k + 1][2].lstrip())
                if right and (right.group()[0].islower() or bare[-2].isupper()):
                    left = tokens[-1]
                    joined = (left + right.group()).lower()
                    yield doc, numbers[p], i + 1, "cut", joined, f"{left}-{right.group()}".lower() if bare[-1] in "-‐" else None, None, None
                    skip, last = right.group(), left
            if first and tokens and tokens[0] == first:
                tokens = tokens[1:]
            if last and tokens and tokens[-1] == last:
                tokens = tokens[:-1]
            # Lines without known words are no text that a scan garbled: figures alone, tables, codes.
            lows = [t.lower() for t in tokens]
            if all(low in known for low in lows):
                continue
            letters = sum(map(len, lows))
            sense = sum(len(t) for t in lows if len(t) > 1 and t in known) >= 0.15 * letters
            if not sense and not all(_PLAIN.match(t) for t in tokens):
                continue
            done = set()
            for j, (token, low) in enumerate(zip(tokens, lows)):
                if low in known or token in done:
                    continue
                done.add(token)
                if _FIGURE.match(token):
                    yield doc, numbers[p], i + 1, "figure", low, None, None, None
                elif any(c.isalpha() for c in token) and len(token) >= 2:
                    yield doc, numbers[p], i + 1, "suspect", low, token, lows[j - 1] if j else None, lows[j + 1] if j + 1 < len(lows) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, rows, title, ready = None, [], None, []

        def out():
            cols = list(zip(*ready))
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], NAMES)

        for batch in batches:
            for d, n, t, ti in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if d != doc:
                    if doc is not None:
                        ready += record(doc, rows, title)
                    doc, rows = d, []
                rows.append((n or 0, t))
                title = ti
                if len(ready) > 20000:
                    yield out()
                    ready = []
        if doc is not None:
            ready += record(doc, rows, title)
        if ready:
            yield out()

    return run


NAMES = ["doc_id", "page_number", "line_no", "kind", "word", "other", "before", "after"]
SEEN = "doc_id string, page_number int, line_no int, kind string, word string, other string, before string, after string"


def weighted_distance(wrong: str, right: str, learned: frozenset[str] = frozenset()) -> float:
    """Edit distance in which confusable characters, and pairs read as one, cost little; `learned` has pairs wrong + right."""
    alike = str.maketrans(*ALIKE)
    a, b = wrong.lower(), right.lower()
    fa, fb = a.translate(alike), b.translate(alike)
    pairs = {p: o for p, o in PAIRS}
    inf = float("inf")
    d = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = d[i][j]
            if here == inf:
                continue
            if i < len(a) and j < len(b):
                cost = 0.0 if a[i] == b[j] else ALIKE_COST if fa[i] == fb[j] else LEARNED_COST if a[i] + b[j] in learned else 1.0
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + cost)
            if i < len(a):
                d[i + 1][j] = min(d[i + 1][j], here + 1)
            if j < len(b):
                d[i][j + 1] = min(d[i][j + 1], here + 1)
            for x, y, fx, fy, step in ((i, j, fa, fb, (2, 1)), (j, i, fb, fa, (1, 2))):
                if x + 2 <= len(fx) and y < len(fy) and pairs.get(fx[x : x + 2]) == fy[y]:
                    u, v = i + step[0], j + step[1]
                    d[u][v] = min(d[u][v], here + PAIR_COST)
    return d[len(a)][len(b)]


def index_keys(folded: Column) -> Column:
    """Keys of which two folded words that are one edit apart, or equal, have one in common.

    The word and its variants with one character deleted, from three characters
    on; for long words their first and last halves, cut at the places where those
    of a word one character longer or shorter are cut.
    """
    n = F.length(folded)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(folded, F.lit(1), i - 1), F.substring(folded, i + 1, n)))
    cuts = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2), F.floor((n + 1) / 2)).cast("array<int>"))
    halves = F.concat(
        F.transform(cuts, lambda c: F.concat(F.lit("<"), F.substring(folded, F.lit(1), c))),
        F.transform(cuts, lambda c: F.concat(F.lit(">"), F.substring(folded, n - c + 1, c))),
    )
    return (
        F.when(n < 3, F.array(folded))
        .when(n < DELETES_TO, F.array_distinct(F.concat(F.array(folded), one)))
        .when(n == DELETES_TO, F.array_distinct(F.concat(F.array(folded), one, halves)))
        .otherwise(halves)
    )


def candidates(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`word, repaired, m`: words of the lexicon with the far more frequent ones whose folded forms are at most an edit away."""
    keyed = words.where(F.length("word") >= 2).withColumn("key", F.explode(let(fold_column(F.col("word")), index_keys)))
    right = keyed.where(~F.col("word").rlike(r"[^\p{L}]")).where(F.col("n") >= ratio)
    right = right.select(F.col("word").alias("repaired"), F.col("n").alias("m"), "key")
    met = keyed.join(right, "key").where((F.col("m") >= F.col("n") * ratio) & (F.abs(F.length("word") - F.length("repaired")) <= 2))
    return met.where("word <> repaired").groupBy("word", "repaired").agg(F.max("m").alias("m"))


def learned_confusions(met: DataFrame, names: DataFrame) -> frozenset[str]:
    """Pairs wrong + right of characters that the corpus confuses.

    For each pair, the words that one replacement of it turns into a candidate, as
    a share of the words with the wrong character that have any candidate; names
    (`names` has `word`), which by chance are like other words, are left out. As
    many rows are collected as the corpus has such pairs of characters.
    """
    plain = met.where(F.length("word") >= 5).join(names.select("word"), "word", "left_anti")
    single = plain.where((F.length("word") == F.length("repaired")) & (F.levenshtein("word", "repaired", 1) == 1))
    at = F.get(
        F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) != F.substring("repaired", i, F.lit(1))), F.lit(0)
    )
    pairs = single.select("word", F.substring("word", at, F.lit(1)).alias("x"), F.substring("repaired", at, F.lit(1)).alias("y"))
    found = pairs.groupBy("x", "y").agg(F.countDistinct("word").alias("found")).where(F.col("found") >= LEARN_WORDS)
    with_x = plain.select("word").distinct().select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("all"))
    kept = found.join(with_x, "x").where(F.col("found") >= LEARN_SHARE * F.col("all")).select(F.concat("x", "y"))
    return frozenset(r[0] for r in kept.collect())


def skeleton(word: Column) -> Column:
    """The folded word with `u` as the two strokes it is read from, so that it doesn't matter which two of three were joined."""
    return F.replace(fold_column(word), F.lit("u"), F.lit("ii"))


def judged(met: DataFrame, learned: frozenset[str], furthest: float = FURTHEST) -> DataFrame:
    """`met` with `distance`, where it is at most `furthest`.

    An edit that is no confusion costs more than that. So only those go on to the
    distance whose folded forms are equal, or may be but for a learned confusion.
    """
    own = [xy for xy in sorted(learned) if fold(xy[0]) != fold(xy[1])]
    cheap = [F.contains("word", F.lit(xy[0])) & F.contains("repaired", F.lit(xy[1])) for xy in own]
    shape = [skeleton(F.col(c)) for c in ("word", "repaired")]
    met = met.where(reduce(or_, cheap, shape[0] == shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [weighted_distance(w, r, learned) for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = pa.array([x <= furthest for x in far], pa.bool_())
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.float64())], [*batch.schema.names, "distance"])
            yield made.filter(keep)

    return met.select("word", "repaired", "m").mapInArrow(run, "word string, repaired string, m bigint, distance double")


def corrections(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`word, repaired, m, distance`: the candidates of each word of `words` (`word, n, name`) that the distance lets through."""
    met = settle(candidates(words, ratio), "met")
    return judged(met, learned_confusions(met, words.where("name")))


def in_context(suspects: DataFrame, fixes: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """`suspects` with `repaired`: the nearest candidate, of equally near ones the one that its neighbours know best; null if there is none.

    A word that mostly stands as a name is only taken for a misreading of a word
    that does not if each of its neighbours is known beside the candidate.
    """
    names = counts.select("word", "name")
    fixed = fixes.join(names, "word").join(names.select(F.col("word").alias("repaired"), F.col("name").alias("is_name")), "repaired")
    fixed = fixed.withColumn("strict", F.col("name") & ~F.col("is_name"))
    rivals = fixed.groupBy("word").agg(F.count(F.lit(1)).alias("rivals"))
    tried = suspects.join(fixed.join(rivals, "word"), "word", "left")
    # Only where there is a choice or a doubt do the neighbours have a say.
    asks = F.col("strict") | (F.col("rivals") > 1)
    tried = settle(
        tried.withColumn("l", F.when(asks, F.xxhash64("before", F.xxhash64("repaired")))).withColumn("r", F.when(asks, F.xxhash64("repaired", F.xxhash64("after"))))
        .withColumn("l", F.when(F.col("before").isNotNull(), F.col("l"))).withColumn("r", F.when(F.col("after").isNotNull(), F.col("r"))),
        "tried",
    )
    asked = tried.select(F.explode(F.array_compact(F.array("l", "r"))).alias("pair")).distinct()
    seen = pairs.where("after IS NOT NULL").select(F.xxhash64("word", "after").alias("pair"), F.col("n").alias("times"))
    known = settle(seen.join(asked, "pair", "left_semi").groupBy("pair").agg(F.sum("times").alias("times")), "contexts")
    scored = tried.join(known.select(F.col("pair").alias("l"), F.col("times").alias("tl")), "l", "left").join(
        known.select(F.col("pair").alias("r"), F.col("times").alias("tr")), "r", "left"
    )
    alone = F.col("before").isNull() & F.col("after").isNull()
    backed = (F.col("before").isNull() | F.col("tl").isNotNull()) & (F.col("after").isNull() | F.col("tr").isNotNull()) & ~alone
    support = F.coalesce("tl", F.lit(0)) + F.coalesce("tr", F.lit(0))
    place = ["doc_id", "page_number", "line_no", "word", "other"]
    fit = F.when(F.col("repaired").isNotNull() & (~F.col("strict") | backed), F.struct("repaired"))
    best = F.min_by(fit, F.when(fit.isNotNull(), F.struct("distance", -support, -F.col("m"), "repaired")))
    return scored.groupBy(*place).agg(best["repaired"].alias("repaired"))


def findings(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """`doc_id, page_number, line_no, kind, word, repaired`: what has to be repaired, one row for each place.

    `pages` has `doc_id, page_number, text`, `titles` has `doc_id, title`. Pages
    without text have no findings; of repeated rows of a page all count as pages.
    The words that are surely right (`SURE`) are sent to the tasks, which pass
    over them; all others are looked up in the whole lexicon.
    """
    pages = pick(pages, doc_id="doc_id", page_number="page_number", text="text")
    titles = pick(titles, doc_id="doc_id", title="title")
    pairs = settle(word_pairs(pages), "pairs")
    counts = settle(lexicon(pairs), "lexicon")
    total = counts.agg(F.sum("n")).first()[0] or 0
    fixes = settle(corrections(counts), "fixes")
    sure = counts.where(~F.col("word").rlike(r"[^\p{L}]")).where(F.col("n") >= max(2, SURE * total))
    # 1 / SURE words at most.
    known = frozenset(r["word"] for r in sure.join(fixes.select("word").distinct(), "word", "left_anti").select("word").collect())
    one_title = titles.groupBy("doc_id").agg(F.min("title").alias("title"))
    ordered = pages.join(one_title, "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "page_number")
    seen = settle(ordered.select("doc_id", "page_number", "text", "title").mapInArrow(examine(known), SEEN), "seen")
    none = F.lit(None).cast("string")
    done = seen.where("kind = 'furniture'").select("doc_id", "page_number", "line_no", "kind", "word", none.alias("repaired"))
    # Cut words: one word unless its parts are known as a compound more often than as one word.
    cuts = seen.where("kind = 'cut'")
    compound = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\p{L})\p{L}++(?:-\p{L}++)+"), F.lit(0)))
    compounds = pages.where(F.contains("text", F.lit("-"))).select(compound.alias("other")).groupBy("other").agg(F.count(F.lit(1)).alias("as_two"))
    whole = counts.select("word", F.col("n").alias("as_one"))
    joined = cuts.join(whole, "word", "left").join(compounds, "other", "left").where(
        F.coalesce("as_two", F.lit(0)) <= F.coalesce("as_one", F.lit(0))
    ).select("doc_id", "page_number", "line_no", F.lit("hyphen").alias("kind"), "word", F.col("word").alias("repaired"))
    suspects = seen.where("kind = 'suspect'").select("doc_id", "page_number", "line_no", "word", "other", "before", "after")
    plain = in_context(suspects, fixes, pairs, counts)
    # Letters and signs mixed in a word are a misreading even where the word itself is unknown.
    odd = F.col("other").rlike(r"^\p{Lu}?\p{Ll}*(?:[01569@$|!]{1,2}\p{Ll}+)+$") & F.col("other").rlike(r"\p{L}.*\p{L}.*\p{L}")
    wrong = plain.where(F.col("repaired").isNotNull() | odd).select(
        "doc_id", "page_number", "line_no", F.lit("misread").alias("kind"), "word", F.coalesce("repaired", "word").alias("repaired")
    )
    figures = seen.where("kind = 'figure'").select(
        "doc_id", "page_number", "line_no", F.lit("misread").alias("kind"), "word", F.translate("word", "lio", "110").alias("repaired")
    )
    return done.unionByName(joined).unionByName(wrong).unionByName(figures)


def repaired_text(pages: DataFrame, found: DataFrame) -> DataFrame:
    """`doc_id, text`: the pages of each record as continuous paragraphs, repaired.

    Furniture goes, cut words are joined with the rest on the next line,
    misread words are replaced, and lines run on until a blank line.
    """
    pages = pick(pages, doc_id="doc_id", page_number="page_number", text="text")
    fixes = found.groupBy("doc_id").agg(F.collect_list(F.struct("page_number", "line_no", "kind", "word", "repaired")).alias("fixes"))
    rows = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), []
            for parts, fixed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at: dict = {}
                for f in fixed or []:
                    at.setdefault((f["page_number"], f["line_no"]), []).append(f)
                out = ""
                for part in parts:
                    for i, line in enumerate((part["text"] or "").split("\n"), 1):
                        here = at.get((part["page_number"], i), [])
                        if any(f["kind"] == "furniture" for f in here):
                            continue
                        words = {f["word"]: f["repaired"] for f in here if f["kind"] == "misread"}
                        if words:
                            line = _TOKEN.sub(lambda m: _as(m.group(), words.get(m.group().lower())), line)
                        if not line.strip():
                            out = out.rstrip(" ") + ("\n\n" if out and not out.endswith("\n\n") else "")
                        elif any(f["kind"] == "hyphen" for f in here):
                            out += line.strip()[:-1]
                        else:
                            out += line.strip() + " "
                texts.append(out.strip())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.join(fixes, "doc_id", "left").mapInArrow(run, "doc_id string, text string")


def _as(word: str, repaired: str | None) -> str:
    """The repaired word in the case of the word it replaces."""
    if repaired is None:
        return word
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return repaired.upper()
    return repaired.capitalize() if word[:1].isupper() else repaired


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        pick(table(spark, sf_dir, "pdf_pages"), doc_id="doc_id", page_number="page_number", text="text"),
        pick(table(spark, sf_dir, "pdf_results"), doc_id="doc_id", title="title"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(*_inputs(spark, sf_dir)).select("doc_id", "page_number", "line_no", "kind").distinct()


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, titles = _inputs(spark, sf_dir)
    return repaired_text(pages, findings(pages, titles))


QUERIES = {"p6_found": p6_found, "p6_text": p6_text}
SQL: dict[str, str] = {}
