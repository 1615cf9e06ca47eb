import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from rolewise.operators import coherence as CO
from rolewise.operators import evidence as EV
from rolewise.operators import intervals as I
from rolewise.operators import linkage as LK
from rolewise.operators import retention as RT
from rolewise.operators import search as SE
from rolewise.sources import ingest as IN


def hits(spark, docs, query, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = spark.createDataFrame([(1, query)], "query_id long, text string")
    return {r["doc_id"]: r for r in SE.bm25(d, q, **kw).collect()}


def test_bm25_behaviour(spark):
    got = hits(spark, ["python kafka", "python", "python", "python"], "python kafka")
    assert got[0]["rank"] == 1 and got[0]["matched_terms"] == ["kafka", "python"]
    got = hits(spark, ["kafka", "kafka " + "mot " * 60, "autre"], "kafka")
    assert got[0]["score"] > got[1]["score"] and 2 not in got
    got = hits(spark, ["kafka x1 x2", "kafka " * 20], "kafka")
    assert got[1]["score"] < 20 * got[0]["score"]
    once, twice = hits(spark, ["kafka", "b"], "kafka"), hits(spark, ["kafka", "b"], "kafka kafka")
    assert twice[0]["score"] == pytest.approx(2 * once[0]["score"])
    assert hits(spark, ["kafka"], "les des") == {}


def test_vector_search_in_blocks_equals_one_block(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    docs = spark.createDataFrame(vectors, "doc_id long, embedding array<double>")
    queries = spark.createDataFrame(vectors[:9], "query_id long, embedding array<double>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    whole = key(SE.vector_top_k(docs, queries, 5))
    assert whole == key(SE.vector_top_k(docs, queries, 5, query_block=2, vector_block=7))
    assert all((i, 1, i) in whole for i in range(9)) and len(whole) == 45


def test_fusion_prefers_agreement(spark):
    schema = "query_id long, doc_id long, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    got = SE.rrf({"bm25": a, "vector": b}).orderBy("rank").collect()
    assert got[0]["doc_id"] == 11 and got[0]["method"] == "bm25+vector"


SCHEMA = "record_id long, email string, phone string, name string, careers array<string>"


def test_entity_resolution_rules(spark):
    rows = [
        (1, "a@x", "", "n1", ["acme"]), (2, "a@x", "", "n2", []), (3, "", "600112233", "n2", ["acme"]),
        (4, "", "600112233", "n4", []), (5, "", "", "n5", ["acme"]), (6, "", "", "n5", ["acme", "b"]),
        (7, "", "", "n5", ["zeta"]), (8, "", "", "n8", ["acme"]),
    ]
    got = {r["record_id"]: r for r in LK.resolve_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    groups = {k: r["group_id"] for k, r in got.items()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert got[1]["confidence"] == pytest.approx(0.70) and got[1]["reasons"] == "email"
    assert got[5]["confidence"] == pytest.approx(0.55) and got[5]["reasons"] == "career,name"


def test_entity_resolution_equals_pairs_on_random_records(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", f"e{rng.randint(0, 25)}"]), rng.choice(["", f"{rng.randint(0, 25)}"]),
             f"n{rng.randint(0, 12)}", [f"c{rng.randint(0, 4)}"]) for i in range(60)]
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    best = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                s = 0.70 * (a[1] == b[1] != "") + 0.55 * (a[2] == b[2] != "") + 0.30 * (a[3] == b[3])
                blocked = s > 0
                s += 0.25 * bool(set(a[4]) & set(b[4]))
                if blocked and s >= 0.55 - 1e-12:
                    best[a[0], b[0]] = min(1.0, s)
                    x, y = sorted((root(a[0]), root(b[0])))
                    parent[y] = x
    want = {}
    for (a, b), s in best.items():
        g = root(a)
        want[g] = max(want.get(g, 0), s)
    got = LK.resolve_entities(spark.createDataFrame(rows, SCHEMA)).collect()
    members = {i for pair in best for i in pair}
    assert {r["record_id"]: r["group_id"] for r in got} == {i: root(i) for i in members}
    assert {r["group_id"]: r["confidence"] for r in got} == pytest.approx(want)


def test_hot_block_makes_links_not_pairs(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("record_id"), F.lit("same@x").alias("email"), F.lit("").alias("phone"),
        F.lit("").alias("name"), F.array().cast("array<string>").alias("careers"))
    assert LK.stars(LK.blocks(rows)).count() == 2000
    got = LK.resolve_entities(rows)
    assert got.count() == 2000 and got.select("group_id").distinct().count() == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    got = LK.connected_components(edges).collect()
    assert len(got) == 41 and {r["component"] for r in got} == {0}


def test_longest_common_substrings_equal_difflib():
    rng = random.Random(2)
    for letters in ("ab", "abc ", "abcdefgh "):
        for _ in range(150):
            page = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
            strings = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
            strings += [page[a:a + rng.randint(1, 30)] or "x" for a in (rng.randint(0, 60),)] + strings[:1]
            for string, (at, size) in zip(strings, EV.longest_common(page, strings)):
                block = difflib.SequenceMatcher(None, page, string, autojunk=False).find_longest_match()
                assert size == block.size and (size == 0 or at == block.a)


def test_work_is_linear_in_page_and_quotes():
    class Counting(dict):
        steps = 0

        def __contains__(self, key):
            Counting.steps += 1
            return dict.__contains__(self, key)

    def steps(n):
        automaton = EV.Automaton(["ab" * 40, "ba" * 40 + "c"])
        automaton.edges = [Counting(e) for e in automaton.edges]
        Counting.steps = 0
        automaton.reached("abx" * n + "ab" * n)
        return Counting.steps

    assert steps(4000) < 2.1 * steps(2000)


def test_blocks_lose_no_match(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip()
    texts = {d: [make(120) for _ in range(3)] for d in range(6)}
    asked = []
    for d in texts:
        for k in range(40):
            page = rng.choice(texts[d])
            cut = rng.randint(0, 80)
            asked.append((d * 100 + k, d, (page[cut:cut + rng.randint(3, 40)] + make(rng.randint(0, 12))).strip()))
    pages = spark.createDataFrame([(d, n, t) for d, listed in texts.items() for n, t in enumerate(listed, 1)],
                                  "document_id long, page int, text string")
    frame = spark.createDataFrame(asked, "quote_id long, document_id long, quote string")
    got = {r.quote_id: (r.page, r.ratio, r.text) for r in EV.anchor_quotes(frame, pages).collect()}
    assert len(got) == len(asked)
    for quote_id, d, quote in asked:
        needle, best = " ".join(quote.split()), None
        for n, text in enumerate(texts[d], 1):
            hay = " ".join(text.split())
            block = difflib.SequenceMatcher(None, hay, needle, autojunk=False).find_longest_match()
            if len(needle) < 12:
                whole = re.search(rf"(?<!\w){re.escape(needle)}(?!\w)", hay) if len(quote) >= 3 else None
                ratio = 0.75 if whole else 0.0
            else:
                ratio = block.size / len(needle)
            if ratio >= 0.6 and (best is None or ratio > best[1]):
                best = (n, ratio)
        assert got[quote_id][:2] == ((best[0], round(best[1] + 1e-9, 3)) if best else (None, 0.0)), quote


def test_spaces_of_other_scripts_are_spaces(spark):
    pages = spark.createDataFrame([(1, 1, "Un\u00a0\u2003ingénieur\u3000logiciel confirmé"), (1, 2, None)],
                                  "document_id long, page int, text string")
    asked = spark.createDataFrame([(1, 1, "\u00a0ingenieur logiciel confirme "), (2, 1, None), (3, 2, "nulle part ailleurs")],
                                  "quote_id long, document_id long, quote string")
    got = {r.quote_id: r for r in EV.anchor_quotes(asked, pages).collect()}
    assert got[1].ratio == 1.0 and got[1].text == "ingénieur\u3000logiciel confirmé"
    assert not got[2].verified and not got[3].verified and len(got) == 3


def test_passages_meet_texts_without_a_key_for_all(spark):
    from rolewise.operators import search as SE

    rng = random.Random(6)
    words = ["the", "ab", "abc", "xyz", "q", "lorem", "ipsum"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    asked = ["", "q", "ab", "b x", "he a", "orem ip", "the ab", "zzz", "ab abc xyz", "e ab q lo"] + [
        t[rng.randint(0, 5):][:rng.randint(1, 25)].strip() for t in texts[:20]]
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id long, needle string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, haystack string")
    got = sorted(map(tuple, SE.holding(passages, frame).collect()))
    assert got == [(i, d) for i, a in enumerate(asked) for d, t in enumerate(texts) if a and a in t]


def test_many_quotes_of_one_document_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(EV, "CHUNK", 10)
    asked = spark.range(95).select("id", F.lit(1).alias("document_id"), F.lit("exactly this sentence").alias("quote"))
    arrays = EV.needles(asked.withColumnRenamed("id", "quote_id"))
    sizes = [r.n for r in arrays.select(F.size("quotes").alias("n")).collect()]
    assert sum(sizes) == 95 and len(sizes) > 5


def test_anchoring_tiers(spark):
    page = "Développeuse  senior chez Acme.\nMySQL et Python depuis 2019, équipe de douze."
    pages = spark.createDataFrame([(1, 1, "rien ici"), (1, 2, page)], "document_id long, page int, text string")
    quotes = ["DEVELOPPEUSE SENIOR chez acme", "SQL", "python", "Python depuis 2019, equipe de vingt",
              "tout autre chose inventee", "ab"]
    df = spark.createDataFrame([(i, 1, q) for i, q in enumerate(quotes)],
                               "quote_id long, document_id long, quote string")
    got = {r["quote_id"]: r for r in EV.anchor_quotes(df, pages).collect()}
    assert got[0]["ratio"] == 1.0 and got[0]["text"] == "Développeuse  senior chez Acme"
    assert got[0]["page"] == 2 and page[got[0]["char_start"]:got[0]["char_end"]] == got[0]["text"]
    assert not got[1]["verified"]
    assert got[2]["ratio"] == 0.75 and got[2]["text"] == "Python"
    assert 0.6 <= got[3]["ratio"] < 1.0 and got[3]["text"].startswith("Python depuis 2019")
    assert not got[4]["verified"] and not got[5]["verified"]


PERIODS = "candidate_id long, experience_id long, start_date date, end_date date"


def periods(spark, rows):
    import datetime as dt

    parse = lambda s: dt.date.fromisoformat(s) if s else None
    return spark.createDataFrame([(1, i, parse(a), parse(b)) for i, (a, b) in enumerate(rows)], PERIODS)


def test_overlap_and_break_findings(spark):
    both = periods(spark, [("2020-01-01", "2023-01-01"), ("2021-06-01", "2024-01-01")])
    assert CO.overlaps(both, "2026-07-30").count() == 1
    assert CO.breaks(both, "2026-07-30").count() == 0
    apart = periods(spark, [("2020-01-01", "2020-06-01"), ("2021-06-01", None)])
    assert CO.breaks(apart, "2026-07-30").first()["amount"] == 365.0
    assert CO.overlaps(apart, "2026-07-30").count() == 0


def test_attention_comes_first(spark):
    rows = [(1, "break", "information", 1, 2), (1, "overlap", "attention", 1, 3), (1, "absent", "attention", 4, -1),
            (2, "break", "information", 1, 2)]
    findings = spark.createDataFrame(rows, "candidate_id long, code string, severity string, first_id long, second_id long")
    got = {(r.candidate_id, r.position): r.code for r in CO.report_order(findings).collect()}
    assert got == {(1, 1): "absent", (1, 2): "overlap", (1, 3): "break", (2, 1): "break"}


def test_overlaps_equal_all_pairs(spark):
    import datetime as dt

    rng = random.Random(9)
    base = dt.date(2000, 1, 1)
    rows = [(base + dt.timedelta(rng.randint(0, 900)), rng.randint(-30, 400)) for _ in range(40)]
    spans = [(a, a + dt.timedelta(n)) for a, n in rows]
    want = {tuple(sorted((i, j))) for i, a in enumerate(spans) for j, b in enumerate(spans)
            if i < j and (min(a[1], b[1]) - max(a[0], b[0])).days > 62}
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], PERIODS)
    got = {tuple(sorted((r["first_id"], r["second_id"]))) for r in CO.overlaps(df, "2010-01-01").collect()}
    assert got == want and len(want) > 20


def test_tenure_counts_parallel_jobs_once(spark):
    df = periods(spark, [("2020-01-01", "2021-01-01"), ("2020-06-01", "2021-01-01"), ("2022-05-01", "2022-01-01")])
    years = I.merged_tenure(df, "2024-01-01").first()["total_experience_years"]
    assert years == pytest.approx(366 / 365.25)


def test_retention_never_selects_null(spark):
    df = spark.sql("SELECT 1 AS candidate_id, DATE '2023-01-01' AS created_at, CAST(NULL AS DATE) AS retention_until")
    assert RT.expired(df, "2026-01-01").count() == 0
    assert RT.expired(RT.with_default_retention(df), "2026-01-01").count() == 1


def test_ingest_is_idempotent(spark):
    docs = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "content_hash string, seq long")
    first = IN.new_documents(docs, docs.limit(0), "seq")
    assert {(r["content_hash"], r["seq"], r["copies"]) for r in first.collect()} == {("h1", 1, 2), ("h2", 3, 1)}
    assert IN.new_documents(docs, first, "seq").count() == 0


def test_closure_has_no_longest_chain(spark):
    from rolewise.operators import ontology

    chain = spark.createDataFrame([(f"s{k:02d}", f"s{k + 1:02d}") for k in range(25)] + [("s25", "s24")],
                                  "skill string, implied string")
    got = {(r.skill, r.implied) for r in ontology.closure(chain).collect()}
    assert got == {(f"s{a:02d}", f"s{b:02d}") for a in range(26) for b in range(a + 1, 26)} | {("s25", "s24")}


def _arrivals(spark, tmp_path, files=4):
    """The events in several files, newest first, read one file at a time."""
    import os
    import time

    from rolewise.streaming import jobs

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    cuts = [r.t for r in events.selectExpr(f"ntile({files}) OVER (ORDER BY ts) AS t", "ts").groupBy("t").agg(
        {"ts": "min"}).selectExpr("`min(ts)` AS t").orderBy("t").collect()] + [None]
    for k in reversed(range(files)):
        part = events.where(events.ts >= cuts[k])
        part = part if cuts[k + 1] is None else part.where(events.ts < cuts[k + 1])
        part.coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/part{k}") if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/in{k}", exist_ok=True)
        os.makedirs(f"{tmp_path}/in/{k}", exist_ok=True)
        os.rename(f"{tmp_path}/part{k}/{name}", f"{tmp_path}/in/{k}/events.parquet")
        stamp = time.time() - 1000 * (k + 1)
        os.utime(f"{tmp_path}/in/{k}/events.parquet", (stamp, stamp))
    return events, jobs.event_stream(spark, f"{tmp_path}/in/*", "events", events.schema, files=1)


def test_streams_equal_batch_for_many_files_in_any_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from rolewise.streaming import jobs

    events, stream = _arrivals(spark, tmp_path)

    def calls(frame):
        return frame.select(
            F.col("ts").cast("timestamp").alias("created_at"),
            F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
            F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"))

    rows = jobs.drain(calls(stream), "volume", jobs.daily_volume)
    assert rows.select("batch_id").distinct().count() == 4
    assert sorted(map(tuple, jobs.merged_volume(rows).collect())) == sorted(
        map(tuple, jobs.daily_volume(calls(events)).collect()))

    def contents(frame):
        return frame.select(F.col("ts").cast("timestamp").alias("arrived_at"),
                            F.concat_ws("/", "user_id", "event_type").alias("content_hash"))

    kept = jobs.first_contents(jobs.drain(jobs.first_contents(contents(stream)), "contents", mode="update"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, jobs.first_contents(contents(events)).collect()))

    def decisions(frame):
        return frame.select(F.col("user_id").alias("actor"), (F.col("event_id") % 3).alias("object_id"),
                            F.col("ts").cast("timestamp").alias("created_at"), "event_id",
                            F.col("event_type").alias("stage"))

    last = jobs.last_decisions(jobs.drain(decisions(stream), "decisions", jobs.last_decisions))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, jobs.last_decisions(decisions(events)).collect()))


def _file(spark, folder, rows, schema, age):
    """One more file, `age` seconds old, in a streamed folder."""
    import os
    import shutil
    import time
    import uuid

    part = f"{folder}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
    (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{part}/{name}", f"{folder}/{name}")
    os.utime(f"{folder}/{name}", (time.time() - age,) * 2)


def test_a_restart_keeps_the_earliest_arrival(spark, tmp_path):
    import datetime as dt

    from rolewise.streaming import jobs

    schema = "content_hash string, arrived_at timestamp"
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    at = lambda d: dt.datetime(2024, 1, d)
    parts = [[("a", at(5)), ("b", at(2))], [("a", at(1)), ("c", at(9))], [("a", at(3)), ("b", at(2)), ("d", at(4))]]
    for k, rows in enumerate(parts):
        _file(spark, folder, rows, schema, 1000 - k)
        stream = spark.readStream.schema(schema).parquet(folder)
        rows = jobs.drain(jobs.first_contents(stream), "contents", mode="update", out=out)
    got = {r.content_hash: r.arrived_at for r in jobs.first_contents(rows).collect()}
    assert got == {"a": at(1), "b": at(2), "c": at(9), "d": at(4)}
    # A batch reads and writes its own keys, whatever came before.
    sizes = {r.batch_id: r["count"] for r in rows.groupBy("batch_id").count().collect()}
    assert sizes == {0: 2, 1: 2, 2: 3}


def test_readings_may_come_late_and_over_restarts(spark, tmp_path):
    import datetime as dt

    from rolewise.streaming import jobs

    rng = random.Random(5)
    schema = "dimension string, read_at date, ratio double"
    rows = [(rng.choice("xyz"), dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 25)), rng.choice([0.95, 0.93, 0.85, 0.82, 0.7]))
            for _ in range(60)]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(0, 60, 15):
        _file(spark, folder, rows[k:k + 15], schema, 1000 - k)
        stream = spark.readStream.schema(schema).parquet(folder)
        found = jobs.drain(jobs.watched_readings(stream), "alerts", mode="update", out=out)
    whole = jobs.drift_alerts(spark.createDataFrame(rows, schema))
    assert sorted(map(str, jobs.merged_readings(found).collect())) == sorted(map(str, whole.collect()))
    assert {r.alert for r in whole.collect()} == {"", "drift", "legal_gap"}


def test_arrivals_meet_the_profiles_of_their_time(spark, tmp_path):
    from rolewise.operators import scoring as SC
    from rolewise.streaming import jobs
    from tests import hiring as H

    data = H.rows()
    score = jobs.scored_arrivals(lambda: H.tables(spark, data), H.REF_YEAR)
    batch = lambda *ids: spark.createDataFrame(
        [r for r in H.ROWS["applications"] if r[0] in ids], H.SCHEMAS["applications"])
    before = {r.application_id: r.overall for r in score(batch("a1", "a2")).collect()}
    data["candidate_skills"].append((1, "postgresql", 5.0, 2024))
    after = {r.application_id: r.overall for r in score(batch("a1")).collect()}
    full = {r.application_id: r.overall for r in SC.score_applications(
        H.tables(spark, data), ref_year=H.REF_YEAR).collect()}
    assert after["a1"] == pytest.approx(full["a1"]) and after["a1"] > before["a1"]
    assert before["a2"] == pytest.approx(full["a2"])


def test_evaluation_set_of_another_kind_fails_without_reading_kind(spark, tmp_path):
    import json

    import pytest

    from rolewise.sources import tables

    (tmp_path / "set.json").write_text(json.dumps(
        {"name": "n", "kind": "search", "version": "1", "cases": [{"id": "c"}]}))
    cases = tables.evaluation_cases(spark, str(tmp_path / "set.json"), "ranking", "id STRING")
    with pytest.raises(Exception, match="expected a ranking set, found search"):
        cases.select("id").collect()
    assert tables.evaluation_cases(spark, str(tmp_path / "set.json"), "search", "id STRING").count() == 1
