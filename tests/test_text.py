from __future__ import annotations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.chunks import cut_points
from quillspark.functions.contract import CHUNK_BOUNDARIES


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


def chunks_of(text, size=1200, overlap=160):
    points = cut_points(text, size, overlap)
    return [tuple(points[i:i + 4]) for i in range(0, len(points), 4)]


def test_han_runs_give_characters_then_pairs(spark):
    tokens = one(spark, "护肤步骤 Alpha123，敏感肌", T.tokenize("t"))
    assert tokens == ["护", "肤", "步", "骤", "护肤", "肤步", "步骤", "alpha123", "敏", "感", "肌", "敏感", "感肌"]


def test_tokens_of_plain_and_empty_text(spark):
    assert one(spark, "", T.tokenize("t")) == []
    assert one(spark, "Éa-b 3x ΣΑΣ", T.tokenize("t")) == ["éa", "b", "3x", "σασ"]


def test_only_line_endings_change(spark):
    assert one(spark, " a\r\nb\rc\n ", T.normalize_newlines("t")) == " a\nb\nc\n "


def test_hash_parts_keeps_empty_parts(spark):
    import hashlib

    got = one(spark, None, T.hash_parts(F.lit("a"), "t", F.lit(3)))
    assert got == hashlib.sha256(b"a\x1f\x1f3").hexdigest()


def test_chunks_of_han_text_are_valid_and_cover_it():
    text = "中文检索证据。alpha-123\n" * 80
    data = text.encode()
    found = chunks_of(text, 180, 32)
    assert found[0][0] == 0 and found[-1][1] == len(data)
    for start, end, start_char, end_char in found:
        assert end - start <= 180
        assert data[start:end].decode() == text[start_char:end_char]
    for (_, end, _, _), (start, _, _, _) in zip(found, found[1:]):
        assert start <= end and end - start <= 32


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é。，.\n护肤", max_size=400), st.integers(20, 60))
def test_chunk_ends_match_a_plain_search(text, size):
    """Each end is the last boundary in the final part of the budget, found here letter by letter."""
    data, overlap = text.encode(), size // 4
    for start, end, _, _ in chunks_of(text, size, overlap):
        if len(data) - start <= size:
            assert end == len(data)
            continue
        letters, at = [], start
        for c in data[start:].decode():
            letters.append((at, c, at + len(c.encode())))
            at += len(c.encode())
        fitting = [x for x in letters if x[2] <= start + size]
        wanted = [x[2] for x in fitting if x[1] in CHUNK_BOUNDARIES and x[0] >= start + int(size * 3 / 5)]
        assert end == (wanted[-1] if wanted else fitting[-1][2])


def test_byte_slice_and_typo(spark):
    assert one(spark, "a护肤b", T.byte_slice("t", F.lit(1), F.lit(4))) == "护"
    assert one(spark, "abcde", T.typo_variant("t")) == "abde"
    assert one(spark, "ab", T.typo_variant("t")) == "ab测式"


def test_trigram_similarity(spark):
    rows = spark.createDataFrame([("word", "two words"), ("", "")], "a string, b string")
    got = [round(r[0], 6) for r in rows.select(T.gram_similarity(T.trigrams("a"), T.trigrams("b"))).collect()]
    assert got == [round(4 / 11, 6), 0.0]


def test_string_leaves_of_nested_json():
    from quillspark.functions.leaves import string_leaves

    assert sorted(string_leaves('{"a:": ["x, \\"y\\"", {"k": "z"}], "n": 3, "e": null}')) == ["x, \"y\"", "z"]
    assert string_leaves(None) == []


def test_only_a_few_texts_of_a_batch_are_python_objects_at_a_time():
    import pyarrow as pa

    from quillspark.functions.chunks import in_slices

    alive, most = [0], [0]

    class Result(list):
        def __init__(self, items):
            super().__init__(items)
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    kind = pa.list_(pa.int32())
    texts = pa.array(["abc", None, "é"] * 100)
    assert in_slices(texts, lambda t: Result(cut_points(t)), kind, 10).to_pylist() == [[0, 3, 0, 3], [], [0, 2, 0, 1]] * 100
    assert most[0] <= 10 and len(in_slices(texts[:0], cut_points, kind)) == 0


def test_chunk_points_equal_the_plain_cut_points_and_run_no_python(spark):
    """Cut points come from column expressions: no text is sent to a Python worker, whatever its length."""
    import random

    from pyspark.sql import functions as F
    from quillspark.functions.chunks import chunk_points

    rng = random.Random(7)
    letters = ["a", "b", " ", "é", "字", "😀", "\n", ".", "。", "，", "́", "\x00", "\r", "$", "\\"]
    texts = [None, "", "a", "。", "😀" * 2000, "x" * 5000, "字" * 3000, ("w" * 700 + "。") * 9, "." * 4000, "\n" * 1201]
    for plain in range(40):
        weights = [rng.choice((0, 1, 20)) for _ in letters]
        texts.append("".join(rng.choices(letters, weights if any(weights) else None, k=rng.choice((5, 400, 1199, 1200, 1201, 6000)))))
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(4)
    for size, overlap in ((1200, 160), (9, 3), (40, 39), (7, 0)):
        got = df.select("n", chunk_points("t", size, overlap).alias("p")).where("n >= 0")
        if size == 1200:
            assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        some = got if size == 1200 else got.where((F.length("t") < 450) | F.col("t").isNull())
        for n, points in some.collect():
            assert points == cut_points(texts[n], size, overlap), (size, overlap, texts[n])
