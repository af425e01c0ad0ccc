from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import contract as C
from quillspark.operators import lexical, search, vector
from quillspark.operators.containment import containment


def plan(spark, text):
    return lexical.plan_queries(spark.createDataFrame([(1, text)], "query_id bigint, query string")).first()


def test_query_plan_reads_hints_type_and_position(spark):
    p = plan(spark, "笔记 12345 的图片文字在位置 3 写了什么")
    assert (p["hinted_note_ids"], p["preferred_type"], p["preferred_position"]) == ([12345], "note_media", 3)
    assert plan(spark, "评论区里怎么说 9876")["preferred_type"] == "note_comment_cluster"
    assert plan(spark, "评论区里怎么说 9876")["hinted_note_ids"] == []
    assert plan(spark, "笔记参考 4321 和 4321")["hinted_note_ids"] == [4321]
    assert plan(spark, "每日事实")["preferred_type"] == "note_daily_fact"
    assert plan(spark, "根据“敏感肌修护”给出建议")["subject_terms"] == ["敏感", "感肌", "肌修", "修护"]


def test_stop_bigrams_and_single_characters_are_left_out(spark):
    assert plan(spark, "这个问题 a 7")["terms"] == ["个问", "7"]
    assert plan(spark, "肤")["terms"] == ["肤"]
    assert not plan(spark, "x" * 2001)["valid"] and not plan(spark, "  ")["valid"]


def covers(entries, needed):
    """Minimal covers by definition: no smaller span inside still satisfies the query."""
    ok = lambda part: len({t for _, t in part}) >= needed
    found = []
    for i in range(len(entries)):
        for j in range(i, len(entries)):
            part = entries[i:j + 1]
            if ok(part):
                if not ok(part[1:]) and not ok(part[:-1]):
                    found.append(part)
                break
    return found


def test_ranks_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        terms = rng.choice([1, 2, 4, 6])
        places = sorted(rng.sample(range(1, 60), rng.randrange(1, 12)))
        rows.append((terms, [(p, rng.randrange(1, terms + 1)) for p in places]))
    df = spark.createDataFrame(rows, "term_count int, hits array<struct<position:int,term_rank:int>>")
    got = df.select(lexical.cover_density(F.col("hits"), F.col("term_count")), lexical.frequency_rank(F.col("hits"), F.col("term_count"))).collect()
    for (terms, hits), (cover, quick) in zip(rows, got):
        raw = sum(0.1 / (1 + (c[-1][0] - c[0][0]) - (len(c) - 1)) for c in covers(hits, min(2, terms)))
        assert cover == pytest.approx(raw / (raw + 1))
        tf = {t: sum(x == t for _, x in hits) for _, t in hits}
        flat = sum(0.1 * sum(1 / j**2 for j in range(1, n + 1)) / 1.64493406685 for n in tf.values()) / terms
        assert quick == pytest.approx(flat / (flat + 1))


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, chunk_key string, document_key string, note_id bigint, score double, confidence double, tiebreak double")


def test_diverse_selection(spark):
    rows = [(1, "a", "d1", 5, .9, .9, 0.0), (1, "b", "d1", 5, .89, .89, 0.0), (1, "c", "d2", 5, .88, .88, 0.0), (1, "d", "d3", 5, .87, .87, 0.0),
            (1, "e", "d4", None, .80, .80, 0.0), (1, "f", "d5", None, .79, .79, 0.0), (1, "g", "d6", 6, .60, .60, 0.0), (2, "h", "d7", 7, .2, .2, 0.0)]
    got = [(r["chunk_key"], r["rank"]) for r in search.select_diverse(candidates(spark, rows), 0.3).orderBy("rank").collect()]
    assert got == [("a", 1), ("c", 2), ("e", 3), ("f", 4)]


def test_access_before_anything_else(spark):
    projects = spark.createDataFrame([(1, "public", "active"), (2, "private", "active"), (3, "public", "archived")], "id bigint, visibility string, status string")
    members = spark.createDataFrame([(2, 8, "active"), (2, 9, "left")], "project_id bigint, user_id bigint, status string")
    asked = spark.createDataFrame([(1, 1, 0), (2, 2, 8), (3, 2, 9), (4, 2, 0), (5, 3, 8)], "query_id bigint, project_id bigint, user_id bigint")
    got = search.resolve_access(asked, projects, members)
    assert {r["query_id"]: r["access_scope"] for r in got.collect()} == {1: "public", 2: "member", 3: "none", 4: "none", 5: "none"}
    assert {(r["query_id"], r["candidate_count"], r["indexed_terms"], r["run_id"]) for r in search.redacted(got).collect()} == {(3, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, "")}


def test_private_text_does_not_move_public_weights(spark):
    projects = spark.createDataFrame([(1, "public")], "id bigint, visibility string")
    schema = "project_id bigint, visibility string, lexemes array<string>"
    rows = [(1, "public", ["a", "b", "a"]), (1, "public", ["c"])]
    stats = lambda extra: {(r["access_scope"], r["term"]): (r["chunk_frequency"], r["occurrence_count"], round(r["idf"], 9)) for r in lexical.scoped_statistics(spark.createDataFrame(rows + extra, schema), projects).collect()}
    plain, mixed = stats([]), stats([(1, "project", ["a", "z"])] * 3)
    assert plain[("public", "a")] == mixed[("public", "a")] == (1, 2, round(math.log(3 / 2) + 1, 9))
    assert mixed[("member", "a")][:2] == (4, 5) and ("public", "z") not in mixed


CHUNKS = (
    "chunk_key string, project_id bigint, note_id bigint, document_type string, media_position int, lexemes array<string>, "
    "source_type string, visibility string, project_open boolean")
QUERIES = "query_id bigint, query string, project_id bigint, access_scope string, document_types array<string>, source_types array<string>"


def test_media_hint_reaches_its_position(spark):
    rows = [("m1", "note_media", 1, ["a"]), ("m3", "note_media", 3, ["b"]), ("n", "note", None, ["c"])]
    chunks = spark.createDataFrame([(k, 1, 12345, t, p, w, "note", "public", True) for k, t, p, w in rows], CHUNKS)
    planned = lexical.plan_queries(spark.createDataFrame([(1, "笔记 12345 图片文字 位置 3", 1, "member", None, None)], QUERIES))
    terms = spark.createDataFrame([(1, 1, "zz", 1.0, 1)], "query_id bigint, project_id bigint, term string, idf double, term_rank int")
    assert [r["chunk_key"] for r in lexical.match_candidates(planned, terms, chunks).collect()] == ["m3"]


def test_filters_apply_before_matches_are_grouped(spark):
    rows = [("open", "note", "note", "public", True), ("media", "note_media", "note", "public", True), ("private", "note", "note", "project", True),
            ("closed", "note", "note", "public", False), ("source", "note", "comment", "public", True)]
    chunks = spark.createDataFrame([(k, 1, None, t, None, ["w"], s, v, o) for k, t, s, v, o in rows], CHUNKS)
    asked = [(1, "w", 1, "public", None, ["note"]), (2, "w", 1, "member", ["note", "note_media"], None), (3, "w", 1, "none", None, None)]
    planned = lexical.plan_queries(spark.createDataFrame(asked, QUERIES))
    terms = spark.createDataFrame([(q, 1, "w", 1.0, 1) for q in (1, 2, 3)], "query_id bigint, project_id bigint, term string, idf double, term_rank int")
    found = sorted((r["query_id"], r["chunk_key"]) for r in lexical.match_candidates(planned, terms, chunks).collect())
    assert found == [(1, "open"), (2, "closed"), (2, "media"), (2, "open"), (2, "private"), (2, "source")]


def test_statistics_of_wanted_terms_only(spark):
    projects = spark.createDataFrame([(1, "public")], "id bigint, visibility string")
    chunks = spark.createDataFrame([(1, "public", ["a", "b", "a"]), (1, "project", ["c", "b"])], "project_id bigint, visibility string, lexemes array<string>")
    wanted = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a"), (1, "zz")], "project_id bigint, term string")
    every, some = lexical.scoped_statistics(chunks, projects).collect(), lexical.scoped_statistics(chunks, projects, wanted).collect()
    assert sorted(some) == sorted(r for r in every if r["term"] == "b")


def test_fusion_adds_both_ranks(spark):
    lex = spark.createDataFrame([(1, "a", .5, .1), (1, "b", .4, .1)], "query_id bigint, chunk_key string, fts_score double, trigram_score double")
    vec = spark.createDataFrame([(1, "b", .9), (1, "c", .8)], "query_id bigint, chunk_key string, vector_score double")
    got = {r["chunk_key"]: (r["rrf"], r["fts_score"], r["vector_score"]) for r in search.fuse(lex, vec).collect()}
    assert got["a"] == (pytest.approx(1 / 61), .5, 0.0) and got["c"] == (pytest.approx(1 / 62), 0.0, .8)
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61), .4, .9)


def test_nearest_neighbours_match_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector, "POINT_BLOCK", 11)
    rng = np.random.default_rng(5)
    points = [(f"c{i:03d}", rng.normal(size=8).tolist(), i % 2, True, "public" if i % 3 else "project", "note" if i % 4 else "note_media", i % 10, i % 3) for i in range(200)]
    queries = [(q, rng.normal(size=8).tolist(), q % 2, ["member", "public", "none"][q % 3], ["note"] if q % 2 else None, [1, 3, 5] if q == 4 else None, 2 if q == 5 else None) for q in range(10)]
    chunk_df = spark.createDataFrame(points, "chunk_key string, embedding array<double>, project_id bigint, project_open boolean, visibility string, document_type string, note_id bigint, media_position int").repartition(5)
    query_df = spark.createDataFrame(queries, "query_id bigint, embedding array<double>, project_id bigint, access_scope string, document_types array<string>, hints array<bigint>, preferred_position int")
    got = {(r["query_id"], r["chunk_key"], r["vector_rank"]) for r in vector.vector_candidates(query_df, chunk_df, 7).collect()}
    want = set()
    for q, v, project, scope, kinds, hints, position in queries:
        ok = [p for p in points if p[2] == project and scope != "none" and (scope == "member" or p[4] == "public") and (not kinds or p[5] in kinds) and (not hints or p[6] in hints) and (position is None or p[7] == position)]
        cosine = lambda p: float(np.dot(p[1], v) / np.linalg.norm(p[1]) / np.linalg.norm(v))
        want |= {(q, p[0], n + 1) for n, p in enumerate(sorted(ok, key=lambda p: (-cosine(p), p[0]))[:7])}
    assert got == want


def test_clustered_points_are_mostly_skipped(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    points = [(f"c{i:04d}", v.tolist(), 1, True, "public", "note", i, 1) for i, v in enumerate(vectors)] + [("zero", [0.0] * 16, 1, True, "public", "note", 9, 1)]
    chunk_df = spark.createDataFrame(points, "chunk_key string, embedding array<double>, project_id bigint, project_open boolean, visibility string, document_type string, note_id bigint, media_position int").coalesce(1)
    queries = [(q, vectors[q * 7].tolist(), 1, "member", None, None, None) for q in range(30)]
    query_df = spark.createDataFrame(queries, "query_id bigint, embedding array<double>, project_id bigint, access_scope string, document_types array<string>, hints array<bigint>, preferred_position int")
    told = vector.skipped_share(query_df, chunk_df, 5).first()
    assert told["clusters"] > 30 * 30 and told["skipped"] > 0.5
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got = {(r["query_id"], r["chunk_key"]) for r in vector.vector_candidates(query_df, chunk_df, 5).collect()}
    assert got == {(q, f"c{i:04d}") for q in range(30) for i in np.argsort(-(unit @ unit[q * 7]))[:5]}


def test_embedding_errors_become_rows(spark):
    def model(texts):
        return [np.ones(3) if "good" in t else (np.ones(2) if "short" in t else np.array([1, np.nan, 0])) for t in texts]

    rows = spark.createDataFrame([(1, "good"), (2, "short"), (3, "nan")], "id bigint, t string")
    got = {r["id"]: r["error"] for r in vector.embed(rows, "id", "t", model, 3, "Query: ").collect()}
    assert got == {1: None, 2: "expected 3 dimensions, got 2", 3: "vector has a non-finite component"}


def test_index_audit_and_resume(spark):
    manifest = spark.createDataFrame([(i, f"c{i}", f"h{i}") for i in range(5)], "position bigint, chunk_key string, content_hash string")
    store = spark.createDataFrame([("c0", "h0"), ("c2", "changed"), ("c3", "h3"), ("x", "h")], "chunk_key string, content_hash string")
    report = vector.audit_index(manifest, store).first()
    assert (report["missing_points"], report["orphan_points"], report["mismatched_points"], report["exact"]) == (2, 1, 1, False)
    assert vector.resume_position(manifest, store, 4).first()["resume_points"] == 1
    assert vector.resume_position(manifest, store, 1).first()["resume_points"] == 1
    exact = manifest.select("chunk_key", "content_hash")
    assert vector.audit_index(manifest, exact, 5).first()["exact"] and not vector.audit_index(manifest, exact, 4).first()["exact"]


def test_containment_is_exact(spark):
    rng = random.Random(11)
    words = ["ab", "abc", "bca", "cab", "dd", "护肤步骤", "x"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(60)]
    cut = lambda t: t[(a := rng.randrange(len(t))):a + rng.randrange(4, 60)]
    anchors = sorted({cut(t) for _, t in texts for _ in range(3)} | {"not there at all", "ab ab ab ab ab ab ab ab ab ab ab"})
    anchors = [(i, a) for i, a in enumerate(anchors) if len(a) >= 4]
    got = containment(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(anchors, "anchor_id int, anchor string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, a) for t, text in texts for a, anchor in anchors if anchor in text)


def test_candidate_terms_order(spark):
    rows = [(1, 1, "member", ["s1", "s2"], n, t, idf) for n, (t, idf) in enumerate([("w1", 5.0), ("12", 1.0), ("s2", 2.0), ("s1", 1.5), ("lost", None), ("w2", 6.0)])]
    df = spark.createDataFrame(rows, "query_id bigint, project_id bigint, access_scope string, subject_terms array<string>, term_no int, term string, idf double")
    got = [r["term"] for r in lexical.candidate_terms(df, 4).orderBy("term_rank").collect()]
    assert got == ["s2", "s1", "12", "w2"]


def test_weights_of_the_contract():
    assert sum(C.HYBRID_WEIGHTS.values()) == pytest.approx(1.0)
    assert sum(C.LEXICAL_WEIGHTS.values()) == pytest.approx(1.0)


def test_containment_of_tiny_anchors(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, "x"), (3, ""), (4, "éé")], "text_id int, text string")
    anchors = spark.createDataFrame([(1, "abc"), (2, "x"), (3, "é"), (4, "zz"), (5, ""), (6, "c d")], "anchor_id int, anchor string")
    assert {tuple(r) for r in containment(texts, anchors).collect()} == {(1, 1), (2, 2), (4, 3), (1, 6)}


def test_norms_keep_chunks_whose_words_cancel_out_and_take_the_words_of_the_sql(spark, monkeypatch):
    import hashlib

    from quillspark.plans import retrieval as rt

    slots = {}
    for word in (f"w{i}" for i in range(1000)):
        digest = hashlib.sha256(word.encode()).digest()
        slots.setdefault(digest[0] % 64, {}).setdefault(digest[1] % 2, word)
    pair = next(" ".join(both.values()) for both in slots.values() if len(both) == 2)
    rows = [("cancelled", pair), ("empty", "... ² !"), ("number", "ten ½ ten"), ("sigma", "ΟΣ οσ")]
    chunks = spark.createDataFrame(rows, "chunk_key string, content string")
    monkeypatch.setattr(rt.ev, "all_chunks", lambda spark, sf: chunks)
    assert {r["chunk_key"]: r["norm"] for r in rt.embedding_norms(spark, "").collect()} == {"cancelled": 0.0, "number": 2.0, "sigma": 2.0}


def test_a_word_is_hashed_once_however_many_batches_hold_it(monkeypatch):
    from quillspark.functions import embedding

    hashed, sha256 = [], embedding.hashlib.sha256
    monkeypatch.setattr(embedding.hashlib, "sha256", lambda data: hashed.append(data) or sha256(data))
    batches = [[f"twice told ÉTÉ{i % 2} Ab²ab ΑΣ İx" for i in range(32)] for _ in range(3)]
    first, *others = [embedding.hashed_words(texts) for texts in batches]
    assert len(hashed) == len({w.decode() for w in hashed} | {"ab"}) + 1  # "ab" twice: both words of one run
    assert {w.decode() for w in hashed} == {"twice", "told", "été0", "été1", "ab", "ασ", "ix"}
    assert all((first == other).all() for other in others) and first.shape == (32, embedding.DIMENSION)


def test_texts_are_not_cut_into_grams_without_short_anchors(spark, monkeypatch):
    from quillspark.operators import containment as c

    texts = spark.createDataFrame([(1, "One two three four five six seven eight."), (2, "one two three four five six")], "text_id int, text string")
    anchors = spark.createDataFrame([(7, "ne two three four five six seven")], "anchor_id int, anchor string")
    asked, grams = [], c._char_grams
    monkeypatch.setattr(c, "_char_grams", lambda text, *size: (asked.append(text), grams(text, *size))[1])
    assert [tuple(r) for r in c.containment(texts, anchors).select("text_id", "anchor_id").collect()] == [(1, 7)]
    assert not asked


def test_texts_are_looked_through_once_for_the_cases(spark):
    """Scopes are resolved from cases that were written, not from the search for their passages."""
    from quillspark.plans import retrieval

    sf = "/root/testdata/sf0.001"
    assert not any("documents.parquet" in path for path in retrieval.cases(spark, sf).inputFiles())


def test_an_evaluation_looks_for_its_passages_once(spark, monkeypatch):
    from quillspark.plans import retrieval, review

    asked, gold_pairs = [], retrieval.gold_pairs
    monkeypatch.setattr(retrieval, "gold_pairs", lambda *where: (asked.append(where), gold_pairs(*where))[1])
    review.evaluated(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1
