import hashlib
import json
import random
from datetime import datetime
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.functions import rules, text
from docloom.operators import alike, catalog, chunk, dedup, html, links, monitor, pipeline, tables, vector
from docloom.operators.changes import ChangeCapture, ChangeLog, document_states, due_documents, instant, merge_states
from docloom.plans import registry
from docloom.sources import readers
from docloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [("Pay Ksh 500 or KShs. 20", "Pay KES 500 or KES 20"), ("Kshatriya", "KES atriya"), ("ten Kenyan Shillings", "ten KES"), (None, None)],
)
def test_currency(spark, given, wanted):
    assert one(spark, given, text.fix_currency) == wanted


@pytest.mark.parametrize(
    "fn, given, wanted",
    [
        (text.fix_characters, "“a”—b…", '"a"--b...'),
        (text.drop_short_lines, "ab\nx\n\ncd", "ab\n\ncd"),
        (text.drop_rules, "ab\n=====\ncd", "ab\n\ncd"),
        (text.expand_abbreviations, "CBK and CBK", "Central Bank of Kenya (CBK) and CBK"),
        (text.clean_for_embedding, "See page 12 at http://x.y/z now", "See at now"),
        (text.clean_transcript, "[Music] 0:05 um um um hello", "um hello"),
        (text.clean_transcript, "[a-b] um, um, um, hello &#39;x", "[a-b] um hello x"),
        (text.safe_filename, "a/b: c?", "a_b_c"),
        (text.safe_filename, "", "unnamed"),
        (text.date_hint, "Report Mar 2024", "Mar 2024"),
        (text.date_hint, "12/3/2024 Mar 2024", "12/3/2024"),
        (text.video_id, "https://www.youtube.com/watch?v=abcdefghijk", "abcdefghijk"),
        (text.drop_repeated_lines, "a\na\n\na\nb", "a\n\na\nb"),
        (text.file_kind, "x.pdf?y=1", "pdf"),
        (rules.risk_level, "crypto and pension", "very_high"),
        (rules.risk_level, "hello", "medium"),
    ],
)
def test_text(spark, fn, given, wanted):
    assert one(spark, given, fn) == wanted


@pytest.mark.parametrize("given, wanted", [("helb loan", ["student"]), ("student youth", ["general"]), ("the diaspora", ["diaspora"]), (None, ["general"])])
def test_personas(spark, given, wanted):
    assert one(spark, given, rules.personas) == wanted


def test_rules(spark):
    assert one(spark, "personal loan", rules.product_types) == ["loans"]
    assert one(spark, "hello", lambda c: rules.life_stage(c, F.lit("cbk"), F.lit("regulatory"))) == "advanced"
    assert one(spark, "x" * 50, lambda c: rules.relevance(c, F.lit(""))) == pytest.approx(0.15)
    assert one(spark, "Tax policy statistics", lambda c: rules.document_class(c, F.lit(None).cast("string"))) == "policy"
    assert one(spark, "Weather", lambda c: rules.document_class(c, F.lit(""))) == "other"


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, None, 2), (4, None, 3)], "doc_id int, text string, _key int")
    assert {r.doc_id: r.duplicate_of for r in dedup.first_by(rows, F.col("text"), "doc_id").collect()} == {1: None, 2: 1, 3: None, 4: None}
    assert dedup.keep_first(rows.limit(0), F.col("text"), "doc_id").count() == 0
    assert one(spark, "abc", dedup.shingle_set) == ["abc"]
    assert sorted(one(spark, "abcdef", dedup.shingle_set)) == ["abcde", "bcdef"]


def test_tables(spark):
    row = spark.createDataFrame([(["Rate", "Year"], [["9", "2024"]])], "h array<string>, r array<array<string>>")
    got = row.select(tables.to_text(F.col("h"), F.col("r")).alias("t"), tables.to_markdown(F.col("h"), F.col("r")).alias("m")).first()
    assert got.t == "Rate: 9; Year: 2024"
    assert got.m == "| Rate | Year |\n| --- | --- |\n| 9 | 2024 |"
    cells = spark.createDataFrame([([["Rate", "Year"], ["9", "2024"], [" ", "x", "y"]],), ([["one"]],), ([["a", "", "", ""], ["", "", "", ""]],)], "r array<array<string>>")
    made = cells.select(tables.tables_to_text(F.array_compact(F.array(tables.from_rows(F.col("r"))))).alias("t")).collect()
    assert [r.t for r in made] == ["Rate: 9; Year: 2024\nYear: x; Column 3: y", "", ""]
    assert row.select(tables.to_text(F.col("h"), F.col("r"), F.lit("Cap")).alias("t")).first().t == "Cap:\nRate: 9; Year: 2024"
    docs = spark.createDataFrame([(1, "t\n|a|b|\n|c|d|\nu"), (2, None)], "doc_id int, text string")
    assert [(r.kind, r.first_line, r.n_lines) for r in tables.segments(docs).orderBy("segment").collect()] == [("text", 1, 1), ("table", 2, 2), ("text", 4, 1)]
    eight = "\n".join(["words only"] * 8)
    assert one(spark, eight + "\n1 2\n3 4", tables.is_table_page) is False
    assert one(spark, eight.rsplit("\n", 1)[0] + "\n1 2\n3 4\n5 6", tables.is_table_page) is True


def test_html():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h2>Head</h2><p>" + "word " * 20 + '</p><a href="/x">link</a></article></body></html>'
    got = html.parse(page)
    assert got["title"] == "T" and got["headings"] == ["Head"] and "menu" not in got["text"] and got["links"] == [{"text": "link", "href": "/x"}]
    assert html.parse(page, emit_text_nodes=True)["text"].count("word word") > got["text"].count("word word")
    assert html.parse("<p>short</p>") is None and html.parse(None) is None


def test_html_facts_come_in_their_order():
    def facts(head="", body="<p>" + "word " * 20 + "</p>"):
        return html.parse(f"<html><head>{head}</head><body>{body}</body></html>")

    p = "<p>" + "word " * 20 + "</p>"
    assert facts('<meta property="og:title" content=" O "><title>T</title>', "<h1>H</h1>" + p)["title"] == "O"
    assert facts("<title></title>", "<h1>H</h1>" + p)["title"] == "" and facts("", "<h1>A <b>b</b></h1>" + p)["title"] == "Ab"
    assert facts('<meta property="og:description" content="og"><meta name="description" content="d">')["description"] == "d"
    assert facts('<meta name="DC.date" content="2"><meta name="datePublished" content="1">')["date"] == "1"
    assert facts("", "<time>noon</time>" + p)["date"] == "noon" and facts("", '<time datetime="2024"></time>' + p)["date"] == "2024"
    assert facts("", '<i class="Post-DATE">' + "x" * 40 + "</i>" + p)["date"] == "x" * 30
    cut = facts("", '<main><div class="popup">Pop</div><div class="navigation">Kept</div><div id="nav">Nav</div>' + p + "</main>")["text"]
    assert "Pop" not in cut and "Nav" not in cut and "Kept" in cut
    assert "right" in facts("", '<div class="entry-content">' + p + "right</div><div class='post-content'>" + p * 3 + "</div>")["text"]
    assert html.parse("<div>" + "word " * 30 + "</div>") is None  # neither a long enough division nor a body
    quirk = html.parse("<body><article><p>" + "a" * 60 + "</p></article></body>", emit_text_nodes=True)["text"]
    assert quirk.count("a" * 60) == 2 and html.parse("<body><article><p>" + "a" * 60 + "</p></article></body>")["text"].count("a" * 60) == 1


def test_links(spark):
    base = "https://a.example/x/y/z.html?q=1"
    joined = {"m": "https://a.example/x/y/m", "../m": "https://a.example/x/m", "../../../m": "https://a.example/m", "/m": "https://a.example/m", "//b.example/m": "https://b.example/m",
              "http://c.example": "http://c.example", "?p=2": "https://a.example/x/y/z.html?p=2", "./m": "https://a.example/x/y/m"}
    for href, wanted in joined.items():
        assert one(spark, href, lambda c: links.join_url(F.lit(base), c)) == wanted, href
    followed = {"m": True, "#top": False, "mailto:x": False, "tel:1": False, "http://c.example/m": False, "tender/1": False, None: False, "": False}
    for href, wanted in followed.items():
        got = one(spark, href, lambda c: links.is_followed(c, links.join_url(F.lit(base), c), F.lit(base), F.array(F.lit("/TENDER"))))
        assert (got or False) is wanted, href
    assert one(spark, "https://a.example/news/markets/1", links.category) == "market_news"
    assert one(spark, "https://markets.example/other", links.category) == "financial_news"


def brute_verdicts(rows, threshold=0.85):
    urls, hashes, signed, out = {}, {}, [], {}
    for d, _, url, t in sorted(rows, key=lambda r: r[1]):
        s = None if t is None else dedup.signature(t)
        near = next(((o, float((s == x).mean())) for o, x in signed if s is not None and (s == x).mean() >= threshold), None)
        kind = ("url", urls[url], 1.0) if url and url.strip() and url in urls else ("exact", hashes[t], 1.0) if t is not None and t in hashes else ("near", *near) if near else None
        if kind:
            out[d] = kind
            continue
        if url and url.strip():
            urls[url] = d
        if t is not None:
            hashes[t] = d
            signed.append((d, s))
    return out


def test_signatures_by_hand():
    draw = random.Random(42)
    a = [draw.randint(1, 2**32 - 1) for _ in range(128)]
    b = [draw.randint(0, 2**32 - 1) for _ in range(128)]
    hashes = [int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "little") for g in ("abcde", "bcdef")]
    assert dedup.signature(" ABCDEF ").tolist() == [min((x * h + y) % (2**61 - 1) & (2**32 - 1) for h in hashes) for x, y in zip(a, b)]
    assert len(dedup.signature("")) == 128


def test_verdicts_equal_one_by_one(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 3, 8, 20))):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((f"d{i}", i * 3, rng.choice([None, "", " ", f"u{rng.randrange(40)}"]), rng.choice([None, "", "ab", "".join(t), "".join(t), "".join(t)])))
    frame = spark.createDataFrame(rows, "doc_id string, ord bigint, url string, text string").withColumn("key", F.lit(1))
    got = dedup.verdicts(frame).collect()
    assert len(got) == 60
    assert {r.doc_id: (r.duplicate_type, r.duplicate_of, r.similarity) for r in got if r.is_duplicate} == brute_verdicts(rows)
    assert dedup.verdicts(frame.limit(0)).count() == 0
    sizes = dedup.store_sizes(dedup.verdicts(frame), frame).first()
    assert sizes.signatures >= sizes.unique_hashes > 5


def test_alike_texts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "abc", "ABC ", "a" * 50] + ["".join(rng.choice("abcdef") for _ in range(120)) for _ in range(6)]
    for t in texts[5:]:
        for n in (1, 2, 3, 6):
            texts.append(t[:60] + "z" * n + t[60 + n :])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    low = {i: t.lower().strip() for i, t in enumerate(texts) if t is not None}
    first = {i: min(j for j in low if low[j] == low[i]) for i in low}
    sets = {i: {low[i]} if len(low[i]) < 5 else {low[i][k : k + 5] for k in range(len(low[i]) - 4)} for i in set(first.values())}
    links_of = {i: sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85 for j in sets if j != i) for i in sets}
    want = {i: (first[i], links_of[first[i]]) for i in low if links_of[first[i]] or sum(f == first[i] for f in first.values()) > 1}
    assert {r.doc_id: (r.first_id, r.n_links) for r in dedup.alike_texts(frame).collect()} == want and any(n for _, n in want.values())


def disk_files(spark):
    """Size of each file that Spark's shuffles and `settle` keep."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    kept = {}
    while blocks.hasNext():
        f = blocks.next()
        kept[f.getPath()] = f.length()
    folder = session.shared_dir(spark).removeprefix("file:")
    return kept | {str(f): f.stat().st_size for f in Path(folder).rglob("*") if f.is_file()}


def test_alike_texts_keep_no_sets(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(250)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(400)]
    texts += [t.replace(words[0], "other") for t in texts[:40]] + texts[:20]
    frame = session.settle(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    before = disk_files(spark)
    got = {r.doc_id: (r.first_id, r.n_links) for r in dedup.alike_texts(frame).collect()}
    written = sum(n for f, n in disk_files(spark).items() if f not in before)
    assert written < 3 * sum(map(len, texts)), written
    changed = [i for i in range(40) if texts[i] != texts[400 + i]]
    assert changed and all(got[i] == (i, 1) and got[400 + i] == (400 + i, 1) for i in changed) and len(got) == 100


def test_alike_texts_of_one_family(spark, monkeypatch):
    monkeypatch.setattr(alike, "MOST", 40)
    rng = random.Random(13)
    page = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = [page[:k] + rng.choice("xyz") * rng.randrange(1, 9) + page[k:] for k in (rng.randrange(400) for _ in range(60))]
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    want = {i: sum(len(s & o) / len(s | o) >= 0.95 for j, o in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(set(texts)) == 60 and 0 < sum(want.values()) < 60 * 59
    assert {r.doc_id: r.n_links for r in dedup.alike_texts(frame, 0.95).collect()} == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_likely_pairs_hold_all_alike(threshold):
    rng = random.Random(12)
    texts = ["", "a", "ab", "\0", "abcd", "abcde", "x" * 40, "\U0001f600" * 3, "\U0001f600\u00e9abcdef"]
    for size in (5, 6, 7, 9, 12, 20, 33, 60, 150, 400, 1500):
        for _ in range(4):
            t = "".join(rng.choice("abcdefghij") for _ in range(size))
            texts += [t, t[size // 2 :] + t[: size // 2]]
            for part in (0.01, 0.02, 0.03, 0.1):
                n = max(1, int(part * size))
                texts += [t + "".join(rng.choice("klm") for _ in range(n)), t[n:], "".join(rng.choice("klm") if rng.random() < part / 3 else c for c in t)]
    texts = sorted(set(texts))
    sets = [{t} if len(t) < 5 else {t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "low": texts})
    rows = pa.Table.from_batches(alike.sketch_batches([batch], threshold)).to_pylist()
    got = set()
    for cls, part in {(r["cls"], r["part"]) for r in rows}:
        some = [r for r in rows if (r["cls"], r["part"]) == (cls, part)]
        boxes = np.frombuffer(b"".join(r["boxes"] for r in some), dtype=alike._KIND).reshape(len(some), -1)
        a, b = alike.likely(np.array([r["id"] for r in some]), np.array([r["n"] for r in some]), boxes, cls, part, threshold)
        got |= set(zip(a.tolist(), b.tolist()))
    hashes, bounds = alike.gram_hashes(texts)
    assert np.diff(bounds).tolist() == [len(s) for s in sets]
    assert (want or threshold == 1) and want <= got and len(got) < 0.2 * len(texts) ** 2 / 2


def test_pipeline(spark):
    body = "The bank raised its savings account rate for every student loan and each pension. " * 3
    page = f"<html><body><article><p>{body}</p></article></body></html>"
    rows = [("a", "s", "n", "T", "u1", "pdf", "c", None, 1, body, 1, 1), ("b", "s", "n", None, "u1", "pdf", "c", None, 1, "other " * 30, 1, 2), ("c", "s", "n", "", "u3", "HTML", "c", None, 0, page, 1, 3),
            ("d", "t", "n", None, None, "pdf", "c", None, 0, None, 1, 4), ("e", "t", "n", None, None, "txt", "c", None, 0, "short", 1, 5), ("f", "t", "n", "News", None, "article", "c", None, 0, "A story of the market and its shares. " * 9, None, None)]
    raw = spark.createDataFrame(rows, "doc_id string, source_id string, source_name string, title string, url string, doc_type string, category string, date_hint string, pages int, text string, batch_no int, seq_no bigint")
    sources = spark.createDataFrame([("s", "bank", ["x", "y"])], "source_id string, institution_type string, financial_domain array<string>")
    done = pipeline.process(pipeline.inputs(raw, sources)).cache()
    got = {r.doc_id: r for r in done.collect()}
    assert {d: r.status for d, r in got.items()} == {"a": "ok", "b": "duplicate", "c": "duplicate", "d": "error", "e": "error", "f": "ok"}
    assert (got["b"].duplicate_type, got["c"].duplicate_type) == ("url", "exact") and got["a"].financial_domain == "x,y" and got["a"].chunks > 0
    assert got["a"].persona == "student,salaried" and got["d"].persona is None and got["f"].regulatory_class == "news"
    made = {r.source_id: r for r in pipeline.report(done).collect()}
    assert (made["s"].parsed, made["s"].duplicates_skipped, made["t"].errors) == (1, 2, 2)
    total = pipeline.summary(pipeline.report(done)).first()
    assert total.total_input == 6 and total.per_source == {"s": 1, "t": 1}


def test_health_and_alerts(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    none = spark.createDataFrame([(None,)], "built timestamp")
    sick = monitor.health(sources, sources, none, F.lit("2025-02-01")).first()
    assert sick.status == "unhealthy" and len(sick.issues) == 1 and sick.sources_missing == []
    built = spark.createDataFrame([(datetime(2024, 12, 1),)], "built timestamp")
    health = monitor.health(sources, sources.limit(1), built, F.lit("2025-02-01"))
    assert health.first().status == "degraded" and len(health.first().warnings) == 2
    assert monitor.health(sources, sources, built, F.lit("2024-12-02")).first().status == "healthy"
    fresh = spark.createDataFrame([("a", "A", "stale"), ("b", "B", "fresh")], "source_id string, name string, state string")
    covered = spark.createDataFrame([("persona", 10.0), ("category", 90.0)], "tag string, percent double")
    for total, n in ((101, 4), (100, 3)):
        got = monitor.alerts(health, fresh, covered, spark.createDataFrame([(total,)], "total bigint")).collect()
        assert len(got) == n and "1 sources have stale data: A" in {r.message for r in got}


def test_retrieval_policy(spark):
    index = spark.createDataFrame([(i, [float(i)]) for i in range(100)], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0])], "query_id bigint, vector array<float>")
    meta = spark.createDataFrame([(i, "s" if i % 2 else "t", "sme,farmer" if i < 50 else "sme", None) for i in range(100)], "vec_id bigint, source_id string, persona string, life_stage string")

    def ids(**filters):
        return [r.vec_id for r in vector.retrieve(asked, index, meta, 2, **filters).orderBy("rank").collect()]

    assert ids() == [0, 1] and ids(source_id="s") == [1, 3, 5, 7, 9, 11]
    assert ids(persona="sme") == [0, 1]  # none of those found is of the persona alone, so all stay
    assert ids(persona="gone") == [] and ids(source_id="gone") == []


def test_index_of_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    index = spark.createDataFrame(rows + [(9999, None)], "vec_id bigint, embedding array<float>")
    placed, centroids = vector.cells(index, 8)
    asked = index.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r["rank"]): r.vec_id for r in vector.knn(asked, index, 3).collect()}
    assert {(r.query_id, r["rank"]): r.vec_id for r in vector.knn_cells(asked, placed, centroids, 3, nprobe=8).collect()} == exact
    more = spark.createDataFrame([(1000, [0.0] * 8), (5, [0.0] * 8), (1001, None)], "vec_id bigint, embedding array<float>")
    grown = vector.append(placed, more, centroids)
    assert grown.count() == 601 and grown.where("vec_id = 1000 AND cell_id IS NOT NULL").count() == 1
    assert vector.migrate(index, asked)[0] == "flat"
    kind, _, share = vector.migrate(index, asked, nprobe=15, switch=100)
    assert kind == "ivf" and share > 0.9
    assert vector.migrate(index, asked, nprobe=1, switch=100, least=1.01)[0] == "flat"
    assert vector.index_stats(placed).first().index_type == "ivf"


def test_chunks(spark):
    assert chunk.chunk_text("x" * 99) == []
    assert chunk.split_sections("intro\n## A\nbody a\n## B\nbody b") == [("", "intro"), ("## A", "body a"), ("## B", "body b")]
    assert chunk.split_sections("1. one\n2. two") == []
    assert chunk.split_tables("t\n|a|b|\n|c|d|\nu") == [("text", "t"), ("table", "|a|b|\n|c|d|"), ("text", "u")]
    long = "One sentence here. " * 400
    pieces = chunk.split_recursive(long, 1200, 200)
    assert all(len(p) <= 1200 and p in long for p in pieces) and len(pieces) > 5
    body = "b" * 100
    assert chunk.chunk_text("## S\n" + body) == [("text", "## S", f"[Section: ## S]\n\n{body}")]
    docs = spark.createDataFrame([(1, None, None, None), (2, long, "t", "article")], "doc_id bigint, text string, title string, doc_type string")
    made = chunk.chunk_documents(docs).collect()
    assert {r.doc_id for r in made} == {2} and {r.chunk_type for r in made} == {"article"} and made[0].total_chunks == len(made)


def test_vectors(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)] + [(99, None)]
    index = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [3.0, 0.0])], "query_id bigint, vector array<float>")
    assert [r.vec_id for r in vector.knn(asked, index, 3, block=4).orderBy("rank").collect()] == [3, 2, 4]
    assert vector.list_count(100000) == 632 and vector.list_count(1000) == 25
    assert vector.index_kind(100) == "flat" and vector.index_kind(500, "ivf") == "flat" and vector.index_kind(200000) == "ivf"


def test_catalog_and_monitor(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "doc_id string, n int, v string")
    assert {r.doc_id: r.v for r in catalog.upsert(rows, "doc_id", ["n"]).collect()} == {"a": "y", "b": "z"}
    got = spark.createDataFrame([("sme,farmer",), ("general",), (None,)], "p string").select(catalog.has_value(F.col("p"), "sme").alias("x")).collect()
    assert [r.x for r in got] == [True, False, False]
    ages = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2025-01-01'), (TIMESTAMP '2025-01-16'), (TIMESTAMP '2025-01-17'), (NULL) AS t(at)")
    assert [r.x for r in ages.select(monitor.freshness(F.col("at"), F.lit("2025-02-01")).alias("x")).collect()] == ["stale", "aging", "fresh", "no_data"]
    runs = spark.createDataFrame([("s", datetime(2025, 1, i), i, 1 if i == 5 else 0) for i in range(1, 6)], "source string, started_at timestamp, run_id int, errors int")
    assert monitor.source_health(runs).first().success == pytest.approx(0.98)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None)], "page string, target string")
    seeds = spark.createDataFrame([("a",)], "page string")
    assert {r.page: r.depth for r in catalog.crawl(links, seeds, 5).collect()} == {"a": 0, "b": 1, "c": 2}


def test_instants(spark):
    for given in ("2025-01-01T03:00:00+03:00", "2025-01-01T00:00:00Z", "2025-01-01 00:00:00", "2025-01-01T00:00:00.000000", "2025-01-01"):
        assert one(spark, given, lambda c: F.unix_seconds(instant(c))) == 1735689600, given
    for given in ("", "soon", None):
        assert one(spark, given, instant) is None


LOG = "doc_id string, date_scraped string, date_indexed string, content_hash string, arrived_at timestamp"


def capture_of(spark, tmp_path, **options):
    return ChangeCapture(ChangeLog(spark, f"file://{tmp_path}/log"), f"file://{tmp_path}/state", **options)


def test_change_capture_replays_and_skips_nothing(spark, tmp_path):
    def lot(*names, at=datetime(2025, 1, 1)):
        return spark.createDataFrame([(n, "2025-01-01", None, "h", at) for n in names], LOG)

    taken = []

    def noted(rows):
        taken.append(sorted(r.doc_id for r in rows.select("doc_id").collect()))
        return rows

    log = ChangeLog(spark, f"file://{tmp_path}/log")
    assert capture_of(spark, tmp_path).run() is None and capture_of(spark, tmp_path).state() is None
    log.append(lot("d0", "d1", "d1", None))
    first = capture_of(spark, tmp_path, lift=noted)
    plan = first.plan()
    first.process(*plan)  # fails before its commit
    log.append(lot("d2"))
    again = capture_of(spark, tmp_path, lift=noted)
    assert again.plan() == plan  # the open plan is replayed as it stands
    assert again.run() == 1 and taken == [["d0", "d1", "d1"]] * 2
    assert sorted(r.doc_id for r in again.state().collect()) == ["d0", "d1", "d1"]
    assert again.run() == 2 and again.run() is None
    # A null arrival, the same instant again, and a row of long ago come later: each is taken once.
    log.append(lot("d0", at=None))
    log.append(lot("d2"))
    log.append(lot("d1", at=datetime(2024, 12, 31)))
    last = capture_of(spark, tmp_path, lift=noted, segments_per_batch=2)
    assert [last.run(), last.run(), last.run()] == [3, 4, None]
    assert taken[2:] == [["d2"], ["d0", "d2"], ["d1"]]
    assert sorted(r.doc_id for r in last.state().collect()) == ["d0", "d0", "d1", "d1", "d1", "d2", "d2"]
    assert last.pieces() == [(1, 4)]  # four pieces of one batch were merged
    last.prune()
    log.append(lot("d7"))
    assert last.run() == 5 and last.pieces() == [(1, 4), (5, 5)] and last.state().count() == 8


def test_what_failed_is_replaced(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([("d1", 1)], "doc_id string, _position int").withColumnRenamed("_position", "v")
    rows.write.parquet(f"{tmp_path}/log/rows/1")  # an append that failed before its ends were written
    assert log.segments() == [] and log.append(rows) == 1 and log.segments() == [1]
    assert log.append(rows.limit(0)) == 2
    capture = capture_of(spark, tmp_path)
    assert capture.run() == 1 and capture.run() is None and [r.v for r in capture.state().collect()] == [1]
    with pytest.raises(FileExistsError):
        capture.commit(1)


def states_of(spark, rows):
    log = spark.createDataFrame([(*r, 1, i) for i, r in enumerate(rows)], "doc_id string, date_scraped string, date_indexed string, content_hash string, _segment int, _position bigint")
    return document_states(log)


def test_due_documents(spark):
    runs = spark.createDataFrame(
        [(1, datetime(2025, 1, 1), "SUCCESS"), (2, datetime(2025, 1, 10), None), (3, datetime(2025, 1, 20), "success")], "run_id int, started_at timestamp, status string"
    )
    rows = [
        ("ok", "2025-01-01", "2025-01-02", "h"), ("failed", "2025-01-01", "2025-01-12", "h"), ("never", "2025-01-01", None, "h"), ("blank", None, "", None),
        ("changed", "2025-01-01", "2025-01-02", "h"), ("changed", "2025-01-05", None, "h2"), ("before", "2025-01-01", "2024-12-31", "h"),
        ("again", "2025-01-01", "2025-01-21T00:00:00Z", "h"), ("again", "2025-01-01", "2025-01-21T00:00:00Z", "h"),
    ]
    states = states_of(spark, rows)
    due = {"failed", "never", "blank", "changed", "before"}
    assert {r.doc_id for r in due_documents(states, runs).collect()} == due
    merged = merge_states(states)
    assert merged.count() == 8 and {r.doc_id for r in due_documents(merge_states(merged.unionByName(merged)), runs).collect()} == due
    assert due_documents(states.limit(0), runs).count() == 0


def test_late_rows_change_what_is_due(spark, tmp_path):
    runs = spark.createDataFrame([(1, datetime(2025, 1, 1), "success")], "run_id int, started_at timestamp, status string")
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    capture = capture_of(spark, tmp_path, lift=document_states, merge=merge_states)
    schema = "doc_id string, date_scraped string, date_indexed string, content_hash string"
    wanted = [({"a", "b"}, [("a", "2025-01-02", None, "h"), ("b", "2025-01-02", None, "h")]), ({"b"}, [("a", "2025-01-01", "2025-01-01T12:00:00Z", "h")]), (set(), [("b", "2025-01-02", "2025-01-03", "h")])]
    for due, rows in wanted:
        log.append(spark.createDataFrame(rows, schema))
        assert capture.run() is not None
        assert {r.doc_id for r in due_documents(capture.state(), runs).collect()} == due


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"source_id": "s", "documents": [{"doc_id": "d1", "pages": 2}]}))
    assert [r.doc_id for r in readers.manifests(spark, f"{tmp_path}/m.json").collect()] == ["d1"]
    (tmp_path / "a.jsonl").write_text('{"timestamp": "t", "level": "warning"}\nnot json\n')
    assert readers.alerts(spark, f"{tmp_path}/a.jsonl").count() == 1
    assert readers.raw_size_mb(spark, str(tmp_path)).first().files == 2


def test_stream_merge_keeps_each_key_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.merge_new(ingest.stream_table(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", "k")
        spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


FAST = ["docs_per_source", "dedup_exact", "dedup_url", "risk_levels", "document_tags", "flagship_tag_summary", "document_classes", "date_hints", "url_facts", "table_pages", "joined_pages", "clean_plain", "html_pages",
        "page_links", "alike_texts", "knn_flat", "retrieval_by_persona", "manifest_upsert", "tag_coverage", "run_health", "alerts_raised", "hourly_events", "p4_found"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("documents", "raw_docs", "pdf_results", "pdf_pages", "html_results", "embeddings", "doc_metadata", "sources", "runs", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))
