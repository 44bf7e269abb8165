import base64
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import history, main_body, near, packing, quality, repetition, scans, source_lines, tokens
from docloom.session import settle

WORDS = [f"{a}{b}" for a in ("ka", "mo", "ti", "re", "su", "no", "la") for b in ("ri", "to", "na", "be", "zu", "fi", "mi")]


def shingle(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(zip(w, w[1:], w[2:]))


def similar(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def make_texts(seed, groups=12, copies=5, alone=30):
    """Groups of edited copies and texts that are like no other."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 120))]
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.randint(0, 5)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            texts.append(" ".join(edited))
    texts += [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(alone)]
    rng.shuffle(texts)
    return texts


# Problem 8

ODD = [
    "", None, " ", "   two  spaces ", "Zotoru's kiosk — ñandú 12,345.6%", "tab\tand\r\nline ends here", "🙂🙃 é é", "<|endoftext|>",
    "x" * 300, "don't we'll I'd", "日本語テキスト", "----------====", "\u0000\u0007", "a" + " " * 40 + "b",
]


def test_ids_equal_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokens.ByteBpe(frequent_words=10)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert got == {i: encoder.encode_ordinary(t) if t else [] for i, t in enumerate(ODD)}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_rank_file(tmp_path):
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate((b"a", b"b", b"ab"))))
    assert tokens.read_ranks(str(tmp_path / "r")) == {b"a": 0, b"b": 1, b"ab": 2}


# Problem 9


def test_bounds_have_the_least_padding():
    rng = random.Random(3)
    for _ in range(80):
        n = rng.randint(1, 9)
        sizes, k = sorted(rng.sample(range(1, 60), n)), rng.randint(1, 5)
        counts = [rng.randint(1, 9) for _ in sizes]

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))

        options = [list(c) + [sizes[-1]] for r in range(k) for c in itertools.combinations(sizes[:-1], min(r, n - 1))]
        assert cost(packing.bucket_bounds(sizes, counts, k)) == min(map(cost, options))


def test_packing_keeps_whole_items(spark):
    rng = random.Random(4)
    sizes = [rng.randint(0, 130) for _ in range(400)] + [None, 0, 100, 101, 250, 1000] + [7] * 300
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, tokens int, container_no string")
    rows = packing.pack(items, 100, max_buckets=40).collect()
    room = Counter()
    per = defaultdict(list)
    for r in rows:
        if r.container_no is not None:
            room[r.container_no] += r.tokens
        per[r.doc_id].append(r)
    assert max(room.values()) <= 100
    assert sorted(room) == list(range(len(room)))
    for i, s in enumerate(sizes):
        assert sum(r.tokens for r in per[i]) == (s or 0)
        assert len(per[i]) == max(1, -(-(s or 0) // 100))
        assert (per[i][0].container_no is None) == (not s)
    assert sum(room.values()) / (100 * len(room)) > 0.95
    assert packing.pack(items.limit(0), 100).count() == 0
    assert packing.pack(items.where("tokens = 0"), 100).collect()[0].container_no is None


def test_packs_are_one_plan(spark, tmp_path):
    """The plan is as large for three packs as for one, and each pack is as if alone."""
    rng = random.Random(15)
    texts = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "rate " * 200)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    reads = []
    for packs in ([("p8", 8)], [("p8", 8), ("p64", 64), ("p100", 100)]):
        rows = [(name, "byte_bpe_50k", c) for name, c in packs] + [("other", "none", 9)]
        spark.createDataFrame(rows, "pack_name string, tokenizer string, capacity int").write.mode("overwrite").parquet(f"{tmp_path}/pack_sizes.parquet")
        got = packing.p9_packed(spark, str(tmp_path))
        reads.append(got._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
    assert reads[0] == reads[1]
    sizes = packing.document_sizes(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = [(*r, name) for name, c in packs for r in packing.pack(sizes, c).collect()]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert packing.pack_all(sizes, []).count() == 0


# Problem 10


def brute_repeated(words, n=5):
    seen, hit = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit.update(range(i, i + n))
        seen.add(g)
    return len(hit)


def test_repeated_share(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS[:4]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += [None, "", "  ", "one two three four five " * 20, "a a a a a a", "A b C d e, 1 a B c D E."]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in repetition.document_shares(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        assert got[i].n_words == len(words)
        assert got[i].repeated_share == pytest.approx(brute_repeated(words) / len(words) if words else 0.0)
        assert got[i].lang == "unknown"


def test_thresholds_fall_back_and_keep_their_bounds(spark):
    rows = [(i, "en", "big", 50, i / 1000) for i in range(200)] + [(1000 + i, "en", "small", 50, 0.9) for i in range(3)] + [(2000, "sw", "s", 50, 0.0)]
    shares = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, n_words bigint, repeated_share double")
    got = {(r.lang, r.source): r.threshold for r in repetition.adaptive_thresholds(shares, quantile=0.5, lowest=0.05, highest=0.5).collect()}
    assert got[("en", "big")] == pytest.approx(0.1, abs=0.02) and got[("en", "small")] == pytest.approx(0.1, abs=0.02)
    assert 0.05 <= got[("sw", "s")] <= 0.5
    fixed = repetition.adaptive_thresholds(shares, lowest=0.3, highest=0.3)
    assert {r.threshold for r in fixed.collect()} == {0.3}
    assert repetition.repetitive_documents(shares, fixed).count() == 3


# Problem 5


def test_lines_of_a_source(spark):
    rng = random.Random(6)
    docs = []
    for i in range(30):
        body = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(5)]
        if i < 9:
            body[1:1] = [f"Share this page, No. {i}!", "Prepared by the whole team"]
        if i < 7:
            body.append("only seven have this line")
        body += ["two words", ""]
        docs.append((f"d{i}", "\n".join(body), "x"))
    docs += [("null", None, "x"), docs[0]]
    meta = [(f"d{i}", "s") for i in range(30)] * 2 + [("null", "s"), ("other", None)]
    frame = spark.createDataFrame(docs, "doc_id string, text string, source_id string").withColumnRenamed("source_id", "gone")
    sources = spark.createDataFrame(meta, "doc_id string, source_id string")
    got = sorted((r.doc_id, r.line_no) for r in source_lines.repeated_lines(frame, sources).collect())
    assert got == sorted((f"d{i}", n) for i in range(9) for n in (2, 3))
    found = source_lines.frequent_sequences(source_lines.line_sequences(frame, sources))
    assert {r.length for r in found.select("length").distinct().collect()} == {1, 2}
    clean = source_lines.without_lines(frame, source_lines.repeated_lines(frame, sources)).where("doc_id = 'd3'").first()
    assert "Share" not in clean.text and clean.removed == 2
    assert source_lines.repeated_lines(frame.limit(0), sources).count() == 0


def test_sequences_equal_brute_force(spark):
    """Frequent lines with other frequent lines between them, some of them twice in a document."""
    rng, kinds = random.Random(14), [f"the line {w} here" for w in WORDS[:3]]
    docs = {f"d{i}": [rng.choice(kinds) if rng.random() < 0.8 else f"alone is {w}{i}" for w in rng.choices(WORDS, k=rng.randint(1, 9))] for i in range(40)}
    docs |= {f"gap{i}": ["first of all lines", *([kinds[0]] if i % 2 else [kinds[1], "never twice so"]), "last of all lines"] for i in range(8)}
    support, starts = Counter(), Counter()
    for d, own in docs.items():
        for n in (1, 2, 3):
            seen = {(tuple(own[p] for p in places), places[0]) for places in itertools.combinations(range(len(own)), n)}
            support.update({k for k, _ in seen})
            starts.update(k for k, _ in seen)
    frame = spark.createDataFrame([(d, "\n".join(own)) for d, own in docs.items()], "doc_id string, text string")
    sources = spark.createDataFrame([(d, "s") for d in docs], "doc_id string, source_id string")
    found = source_lines.frequent_sequences(source_lines.line_sequences(frame, sources)).collect()
    rows = [(tuple(docs[r.doc_id][n - 1] for n in r.line_nos), r) for r in found]
    assert all(r.length == len(k) and r.line_nos == sorted(set(r.line_nos)) for k, r in rows)
    assert {k: r.n_docs for k, r in rows} == {k: n for k, n in support.items() if n >= 8}
    assert Counter(k for k, _ in rows) == {k: n for k, n in starts.items() if support[k] >= 8}
    assert ("first of all lines", "last of all lines") in {k for k, _ in rows} and {len(k) for k, _ in rows} == {1, 2, 3}


# Problem 2


def brute_groups(texts, threshold=0.7):
    sets = [shingle(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if similar(sets[i], sets[j]) >= threshold:
            root[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("few", [16, 2])
def test_groups_equal_brute_force(spark, few):
    texts = make_texts(7) + ["", None, "two words", "two words", "The same text HERE!", "the same, text here", "the same text here"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, cls int")
    rows = near.NearDuplicates(docs, few=few).groups().collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.group_id].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts)
    sets = [shingle(t) for t in texts]
    assert all(r.similarity == (None if r.duplicate_of is None else pytest.approx(similar(sets[r.doc_id], sets[r.duplicate_of]))) for r in rows)
    firsts = {r.doc_id: r.duplicate_of for r in rows}
    assert all(firsts[min(g)] is None and {firsts[x] for x in g - {min(g)}} <= {min(g)} for g in groups.values())


def test_one_group_of_near_copies_may_be_most_of_the_rows(spark):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(90)]
    texts = []
    for i in range(120):
        edited = list(base)
        edited[rng.randrange(90)] = f"word{i}"
        texts.append(" ".join(edited))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = near.NearDuplicates(docs).groups().collect()
    assert len(rows) == 120 and len({r.group_id for r in rows}) == 1
    assert near.NearDuplicates(docs.limit(0)).groups().count() == 0


def template_texts(seed, many=40, linked=3):
    """`many` texts that are mutually unlike, then near copies of the last `linked` of them."""
    rng = random.Random(seed)
    unlike = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(many)]
    copies = [[*w[:30], "edited", *w[31:]] for w in unlike[-linked:]]
    return [" ".join(w) for w in unlike + copies]


def share_one_table(rows):
    """As if all but one of the first table's symbols came from a part that all texts have in common, and the others from their own."""
    own = F.transform(F.sequence(F.lit(0), F.lit(near.WIDTH * near.TABLES - 1)), lambda i: F.when(i < near.WIDTH - 1, i.cast("int")).otherwise(F.hash("cls", i)))
    return rows.withColumn("symbols", F.when(F.col("cls").isNotNull(), own))


def test_long_variant_inside_a_partition_loses_no_link(spark):
    texts = template_texts(3)
    found = near.NearDuplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    found.classes = share_one_table(found.classes)
    groups = defaultdict(set)
    for r in found.groups().collect():
        groups[r.group_id].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts) == {frozenset({37, 40}), frozenset({38, 41}), frozenset({39, 42})}


def test_a_template_of_many_texts_is_not_compared_pair_by_pair(spark):
    """1,500 texts of which each shares four tenths with all others, and near copies of a few of them."""
    rng = random.Random(4)
    common = [f"t{i}" for i in range(40)]
    own = [[f"w{rng.randrange(10**7)}" for _ in range(60)] for _ in range(1500)]
    own += [[*w[:20], "edited", *w[21:]] for w in own[700:730]]
    texts = [" ".join(common + w) for w in own]
    found = near.NearDuplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    groups = defaultdict(set)
    for r in found.members().collect():
        groups[r.root].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts) == {frozenset((700 + i, 1500 + i)) for i in range(30)}
    assert len(found.compared) >= 2  # there was a second pass
    assert sum(pairs.count() for pairs in found.compared) < 0.1 * len(texts) ** 2 / 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# Problem 3


def test_addresses(spark):
    same = ["https://www.a.example/x/", "http://A.example:443/x#top", "https://a.example/x?utm_source=m&gclid=1", "https://a.example/x/?sessionid=3"]
    other = ["https://a.example/x?id=3", "https://a.example/X", "https://b.example/x", None, " "]
    frame = spark.createDataFrame([(u,) for u in same + other], "url string").select(history.address(F.col("url")).alias("a"))
    got = [r.a for r in frame.collect()]
    assert set(got[:4]) == {"a.example/x"} and "a.example/x" not in got[4:] and got[-2:] == [None, None]


@pytest.mark.parametrize("few", [16, 2])
def test_batches_equal_one_by_one(spark, few):
    rng = random.Random(9)
    texts = make_texts(10, groups=5, copies=4, alone=6) + ["tiny", "tiny", "", "", None, None]
    rows = []
    for i, t in enumerate(texts):
        url = rng.choice([None, f"https://w.example/{rng.randint(0, 60)}", f"http://www.w.example/{rng.randint(0, 60)}/?utm_id=1"])
        rows.append((f"d{i}", 1 + i * 2 // len(texts), i, url, t, "x"))
    urls, seen, sets, want = set(), set(), [], {}
    for d, _, _, url, t, _ in rows:
        key = None if url is None else re.search(r"/(\d+)", url).group(1)
        kind = "url" if key in urls and key else "exact" if t is not None and t in seen else "near" if any(similar(shingle(t), s) >= 0.7 for s in sets) else None
        if kind:
            want[d] = kind
        else:
            urls.add(key)
            seen.add(t)
            sets.append(shingle(t))
    frame = spark.createDataFrame(rows, "doc_id string, batch_no int, seq_no bigint, url string, text string, cls string")
    got = history.check_batches(frame, few=few).collect()
    assert {r.doc_id: r.duplicate_type for r in got} == want


def test_copies_of_a_record_that_leads_no_long_variant(spark):
    texts = template_texts(3)
    frame = spark.createDataFrame([(f"d{i}", 1, i, None, t) for i, t in enumerate(texts)], "doc_id string, batch_no int, seq_no bigint, url string, text string")
    own = F.transform("balls", lambda key, i: F.when(i == 0, F.lit(7).cast("bigint")).otherwise(F.xxhash64("cls", i)))
    rows = settle(history.features(frame).withColumn("balls", own))
    known = history.History(spark)
    known.check(rows, 1)
    assert {r.doc_id: r.duplicate_type for r in known.verdicts(rows).collect()} == {"d40": "near", "d41": "near", "d42": "near"}
    known.close()


# Problem 1


def test_lines_tell_prose_from_the_rest(spark):
    prose = "\n".join(["The bank raised the rate in March, so that each buyer may pay more for it.", "If any owner sold a share, the price of the fund was lower than before."] * 4)
    tabular = "Yearly rates\n" + "\n".join(f"{i}.5   {i * 7}   {i},300" for i in range(12))
    mixed = prose + "\n- first item\n- second item\nFund   12   13"
    rows = [("p", prose), ("upper", prose.upper()), ("t", tabular), ("m", mixed), ("j", "x9$ {}[] ;;== a1b2 ##\n" * 5), ("n", None), ("e", ""), ("b", " \n ")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id string, text string, words int")
    common = spark.createDataFrame([("en", w) for w in "the a in so that each may for it if any of was than before by more".split()] + [(None, None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.text_statistics(docs, common, model=quality.START).collect()}
    assert got["p"].prose_share == 1.0 and got["upper"].prose_share == 1.0 and got["m"].prose_share > 0.5
    assert got["t"].prose_share < 0.5 and got["j"].prose_share < 0.5
    assert got["p"].words == len(prose.split()) and got["p"].lines == 8 and got["p"].punctuated_lines == 1.0
    assert all(got[d].words == got[d].lines == 0 and got[d].prose_share == 0 for d in ("n", "e", "b"))


def brute_counts(line, common):
    """Tokens, firm, joining, joining_sw, figures, odd of a line, token by token."""
    if len(re.findall(r"[,;|](?=[\"\d\-n])(?<![\d][,;|](?=\d{3}\b))", line)) > 1:
        line = re.sub(r"[,;|](?=[\"\d\-n])(?<![\d][,;|](?=\d{3}\b))", " ", line)
    out = Counter(tokens=len(line.split()))
    for token in line.split():
        words = re.findall(r"[^\W\d_]+", token)
        if any(c.isdigit() for c in token) and not (words and len(words[0]) > 2):
            out["figures"] += 1
        elif not words:
            out["figures"] += token in ("-", "|")
            out["odd"] += token not in ("-", "|", "&", "\u2013", "\u2014")
        else:
            word = words[0].lower()
            kind = "joining" if word in quality.JOINING else "joining_sw" if word in quality.JOINING_SW else "firm" if word in common else None
            odd = re.search(r"[^\w\s.,;:!?'\"()&/%$\-\u2010-\u201d\u00ad@]|[a-z][A-Z]|[\[\]{}=;]\S|\w\(|[A-Za-z]\d[A-Za-z]", token) or len(token) > 24
            out[kind or ("odd" if odd else "rest")] += 1
    return [out[k] for k in quality.COUNTS]


def test_counts_of_lines_equal_brute_force(spark):
    rng = random.Random(11)
    common = frozenset(("the", "if", "so", "a", "and", "na"))
    pieces = ["the", "The,", "and", "na", "(if", "a1", "a1b2", "fund", "x(y)", "12", "1,300", "12%", "-", "|", "&", "--", "{x}", "camelCase", "w" * 30, "so;is", "q3", "n/a", "\u00e9t\u00e9", "=", "9th", "ab;9", "4;5;6", "\u2014"]
    lines = [rng.choice((" ", "  ", "\t", "     ")).join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["a,b,1,2", "x|1|2|-3", "1,300 and 2,500"]
    docs = spark.createDataFrame([(i, f"{line}\n \n{line}") for i, line in enumerate(lines)], "doc_id int, text string")
    for r in docs.select("doc_id", quality.line_counts(F.col("text"), common).alias("lines")).collect():
        assert [[r.lines[i][k] for k in quality.COUNTS] for i in (0, 1)] == [brute_counts(lines[r.doc_id], common)] * 2, lines[r.doc_id]
        assert [x.chars for x in r.lines] == [len(lines[r.doc_id].strip())] * 2


def test_fit_follows_the_lines_and_keeps_what_it_has_not_seen():
    rng = np.random.default_rng(3)
    chances = np.array([0.4, 0.02, 0.002, 0.02, 0.002])
    lines = rng.multinomial(40, [*chances, 1 - chances.sum()], size=4000)
    counts = np.column_stack([lines.sum(axis=1), lines[:, :5]]).astype(float)
    model = quality.fit(counts, np.zeros(4000), np.arange(0, 4000, 20), weight=500)
    assert np.allclose(model.chances[0], chances, atol=0.01) and np.allclose(model.chances[2], quality.START.chances[2])
    none = quality.fit(np.zeros((0, 6)), np.zeros(0), np.zeros(0, dtype=int))
    assert none is quality.START


def test_model_is_fitted_to_all_records(spark, monkeypatch):
    rng, label, models = random.Random(13), quality.label, []
    pieces = ["the", "and", "na", "fund", "12", "1,300", "{x}", "Rates", "-", "a1b2"]
    texts = ["\n".join(" ".join(rng.choice(pieces[i % 5 :]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))) for i in range(2500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id int, text string")
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    monkeypatch.setattr(quality, "label", lambda model: models.append(model) or label(model))
    assert quality.label_shares(docs, common).count() == 2502
    rows = docs.orderBy("doc_id").select(quality.line_counts(F.col("text"), frozenset(("the",))).alias("lines")).toArrow()
    counts, bullets, _, starts, owners = quality._lines(rows.combine_chunks().to_batches()[0].column(0))
    whole = quality.fit(counts, bullets, starts, weight=quality.WEIGHT * 2500 / quality.BESIDE)
    assert len(owners) == 2500 and np.array_equal(models[0].chances, whole.chances) and np.array_equal(models[0].bullets, whole.bullets)
    assert quality.label_shares(docs.limit(0), common).count() == 0 and models[1] is quality.START


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    starts, lengths = [], [1, 4, 3, 5]
    scores = rng.normal(size=(sum(lengths), 4)) * 3
    for n in lengths:
        starts.append(sum(lengths[: len(starts)]))
    got = quality.viterbi(scores, np.array(starts), quality.START.move)
    stay, move = np.log(0.9), np.log(0.1 / 3)
    for s, n in zip(starts, lengths):
        best = max(itertools.product(range(4), repeat=n), key=lambda p: sum(scores[s + i, k] for i, k in enumerate(p)) + sum(stay if a == b else move for a, b in zip(p, p[1:])))
        assert tuple(got[s : s + n]) == best


# Problem 7


def test_main_body(spark):
    long = "The bank raised the rate for each buyer of a share in March. It may lower the price again before the end of the year, or so the board said."
    pages, meta = [], []
    for i in range(12):
        title = f"Rates of the year {WORDS[i]}"
        text = "\n".join(["Home | News | Rates", f"Home > News > {title}", title, long.replace("March", WORDS[i]), "", f"A heading {WORDS[i]}", long.replace("board", WORDS[i + 3]), f"Tags: a, {WORDS[i]}", "Most read", f"Story about {WORDS[i + 5]} and more", "© 2024 The Site", "Accept all"])
        pages.append((f"d{i}", text, title, [f"Story about {WORDS[i + 5]} and more"]))
        meta += [(f"d{i}", "s", "HTML")] * 2
    pages += [("data", "a\nb", None, None), ("null", None, None, None), ("empty", "", None, None)]
    meta += [("data", "s", "csv"), ("null", "s", "html"), ("empty", "s", "htm")]
    frame = spark.createDataFrame(pages, "doc_id string, text string, title string, links array<string>").withColumn("source_id", F.lit(1))
    known = spark.createDataFrame(meta, "doc_id string, source_id string, doc_type string")
    got = defaultdict(list)
    for r in main_body.outside_lines(frame, known).collect():
        got[r.doc_id].append(r.line_no)
    assert {d: sorted(v) for d, v in got.items()} == {f"d{i}": [1, 2, 8, 9, 10, 11, 12] for i in range(12)}
    assert main_body.outside_lines(frame.limit(0), known).count() == 0


# Problem 6


@pytest.mark.parametrize("wrong, right", [("thcir", "their"), ("cornmon", "common"), ("Holclings", "Holdings"), ("an0ther", "another"), ("payroU", "payroU"), ("vvork", "work"), ("accourit", "account")])
def test_confusions_cost_little(wrong, right):
    assert scans.weighted_distance(wrong, right) < 1
    assert scans.weighted_distance(wrong, right + "xy") >= 1


def test_scans(spark):
    sentence = "the common account of their bank may cover another risk based order in the market"
    pages = []
    for d in range(8):
        for p in (1, 2, 3):
            lines = [f"Yearly report of the fund {d}", sentence, "this long account of an ord-", "er was sold in the market and every risk-", "based common order of the bank came later", " ".join(WORDS[(d * 15 + p * 5 + k * 3) % 49] for k in range(7)), f"Page {p}"]
            if d == 0 and p == 2:
                lines[1] = sentence.replace("their", "thcir")
            pages.append((f"r{d}", p, "\n".join(lines), 1))
    pages += [("plain", 1, "a risk-based order and a risk-based bank\nrisk-based market", 1), ("none", 1, None, 1)]
    frame = spark.createDataFrame(pages, "doc_id string, page_number int, text string, title int")
    titles = spark.createDataFrame([("r0", None, "x")], "doc_id string, title string, text string")
    found = scans.findings(frame, titles)
    got = {(r.doc_id, r.page_number, r.line_no, r.kind) for r in found.collect()}
    want = {(f"r{d}", p, n, "furniture") for d in range(8) for p in (1, 2, 3) for n in (1, 7)}
    want |= {(f"r{d}", p, 3, "hyphen") for d in range(8) for p in (1, 2, 3)} | {("r0", 2, 2, "misread")}
    assert got == want
    text = {r.doc_id: r.text for r in scans.repaired_text(frame, found).collect()}
    assert "thcir" not in text["r0"] and "an order was sold" in text["r0"] and "Page 2" not in text["r0"] and text["none"] == ""
    assert scans.findings(frame.limit(0), titles).count() == 0


def test_confusions_are_learned(spark):
    bases = ["survey", "reserve", "tender", "ledger", "member", "center"]
    words = [(w, 60) for w in bases] + [(w[0] + w[1:].replace("e", "f", 1), 2) for w in bases] + [("margin", 60), ("margins", 1), ("lender", 1)]
    frame = spark.createDataFrame(words, "word string, n bigint").withColumn("name", F.lit(False))
    got = {r.word: r.repaired for r in scans.corrections(frame).collect()}
    assert got == {w[0] + w[1:].replace("e", "f", 1): w for w in bases}


def test_index_keys_meet_wherever_the_edit_is(spark):
    rng = random.Random(2)
    rows = []
    for n in (3, 5, 31, 32, 33, 34, 60):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        for i in range(n):
            rows += [(word, word[:i] + "z" + word[i + 1 :]), (word, word[:i] + word[i + 1 :]), (word, word[:i] + "z" + word[i:])]
    frame = spark.createDataFrame([r for r in rows if min(map(len, r)) > 2], "a string, b string")
    met = frame.select(F.arrays_overlap(scans.index_keys(F.col("a")), scans.index_keys(F.col("b"))).alias("m"))
    assert {r.m for r in met.collect()} == {True}


def test_headers_are_grouped_without_all_pairs():
    keys = ["yearlyreportofthefund", "yearlyreportofthefunc", "other line entirely", "yearlyreportofthefund"] + [f"{i:04d}{i * 7919:012d}" for i in range(3000)]
    sizes = scans.header_groups(keys)
    assert sizes[:4] == [3, 3, 1, 3] and max(sizes[4:]) < 5


def test_neighbours_pick_the_repair_and_spare_names(spark):
    pages = [("a", p, "pay the bill of the bank before the end\nwe saw the hill of the town before the end\n" * 15, 1) for p in range(1, 4)]
    pages += [("b", 1, "pay the bi1l of the bank before\nwe saw the bil1 of the town before\na share of Biil Motors in the town of the bank", 1)]
    pages += [("c", 1, "the share that Biil Traders sold to the bank of the town", 1)]
    pages += [("d", 1, "\n".join(["the hiil of the town before", "pay the hiil of the bank"]), 1)]
    frame = spark.createDataFrame(pages, "doc_id string, page_number int, text string, title int")
    found = scans.findings(frame, spark.createDataFrame([], "doc_id string, title string")).where("kind = 'misread'").collect()
    got = {(r.doc_id, r.line_no): (r.word, r.repaired) for r in found}
    assert got[("b", 1)] == ("bi1l", "bill") and ("b", 3) not in got and ("c", 1) not in got
    assert got[("d", 1)][0] == "hiil" and got[("d", 1)][1] == "hill"


def test_frequent_misreadings_are_found_like_rare_ones(spark):
    for times in (1, 25):
        pages = [("r", p, "the value of the fund and the value of the bank\n" * 15, 1) for p in range(1, times + 1)]
        pages += [("w", p, "the bank and\nthe valiie of the fund\nof the bank", 1) for p in range(1, times + 1)]
        frame = spark.createDataFrame(pages, "doc_id string, page_number int, text string, title int")
        found = scans.findings(frame, spark.createDataFrame([], "doc_id string, title string")).where("kind = 'misread'").collect()
        assert {(r.doc_id, r.page_number, r.word, r.repaired) for r in found} == {("w", p, "valiie", "value") for p in range(1, times + 1)}


def test_history_goes_on_in_another_process(spark, tmp_path, monkeypatch):
    """Two views of one folder, an undone batch run again, lots merged; negative and null batches, and numbers that occur twice."""
    monkeypatch.setattr(history, "FAN", 3)
    rng = random.Random(12)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(24)]
    state = f"file://{tmp_path}/history"
    schema = "doc_id string, batch_no int, seq_no bigint, url string, text string"

    def batch(number, rows):
        return spark.createDataFrame([(d, number, s, None, t) for d, s, t in rows], schema)

    first = history.check_batches(batch(-1, [("a", 1, texts[0]), ("b", 2, texts[1]), ("c", 2, texts[0])]), state_dir=state)
    assert {r.doc_id: r.duplicate_type for r in first.collect()} == {"c": "exact"}
    again = history.check_batches(batch(-1, [("z", 1, texts[9])]), state_dir=state)  # the batch was done
    assert again.count() == 0 and history.History(spark, state).done() == {-1}
    for n in range(1, 5):
        edited = texts[n - 1].split(" ")
        edited[30] = "edited"
        rows = [(f"n{n}", 1, texts[n]), (f"e{n}", 1, " ".join(edited)), (f"o{n}", None, "o " + texts[n + 10])]
        if n == 3:
            broken = history.History(spark, state)
            broken._accept(history.features(batch(n, rows)), n)  # fails before the batch is done
        got = {r.doc_id: r.duplicate_type for r in history.check_batches(batch(None if n == 4 else n, rows), state_dir=state).collect()}
        assert got == {f"e{n}": "near"} | ({"n1": "exact"} if n == 1 else {}), n
    known = history.History(spark, state)
    assert len(known.lots()) < 5 and known.sets().count() == 2 + 3 + 4
    known.close()


def test_a_batch_against_the_history_takes_few_plans(spark):
    """The driver keeps threads and heap for each plan that it runs, so that a batch has a bound of them."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(18)]
    rows = [(f"d{i}", 1 + i // 6, i, f"https://w.example/{i}", t) for i, t in enumerate(texts)]
    rows += [(f"e{b}", b, 100, None, texts[0].replace(" ", "  ")) for b in (2, 3)] + [(f"f{b}", b, 101, f"https://w.example/{6 * b - 6}#f", None) for b in (2, 3)]
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    took = []
    for batches in (2, 3):
        frame = spark.createDataFrame([r for r in rows if r[1] <= batches], "doc_id string, batch_no int, seq_no bigint, url string, text string")
        bus.waitUntilEmpty(30_000)
        before = store.executionsCount()
        got = {r.doc_id: r.duplicate_type for r in history.check_batches(frame).collect()}
        assert got == {f"e{b}": "near" for b in range(2, batches + 1)} | {f"f{b}": "url" for b in range(2, batches + 1)}
        bus.waitUntilEmpty(30_000)
        took.append(store.executionsCount() - before)
    assert took[1] - took[0] <= 7, took
