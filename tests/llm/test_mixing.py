from __future__ import annotations

import random
import re
from collections import defaultdict

from llm.helpers import AWKWARD, collected, documents

from quillspark.llm import mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_mix(spark, rows: list[tuple], block: int) -> dict:
    """Words taken and slots of every document (id, source, size; unique ids), source by source, word by word of the schedule."""
    hashes = {r["id"]: r["h"] for r in collected(spark.createDataFrame([(i,) for i, _, _ in rows], "id long").selectExpr("id", "xxhash64(id) AS h"))}
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    streams = {s: int(t) for s, t in brute_targets(dict(sizes)).items()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    quotas = {s: -(-streams[s] // block) for s in order}
    total = sum(quotas.values())
    bits = max(1, (max(total, 1) - 1).bit_length())
    slot_of, upto = defaultdict(list), {}
    for s in order:
        upto[s] = sum(quotas[o] for o in order[:order.index(s)]), sum(quotas[o] for o in order[:order.index(s) + 1])
    for slot in range(2**bits):
        point = int(f"{slot:0{bits}b}"[::-1], 2)
        for s in order:
            if upto[s][0] <= point < upto[s][1]:
                slot_of[s].append(slot)
    out = {i: [0, []] for i, _, _ in rows}
    for s in order:
        own = sorted((hashes[i], i, n) for i, o, n in rows if o == s)
        at = 0
        for reading in range(3):
            for _, i, n in own:
                begin, end = at, min(at + n, streams[s])
                at += n
                if n and begin < end:
                    out[i][0] += end - begin
                    out[i][1].append(min(slot_of[s][b] for b in range(begin // block, (end - 1) // block + 1)))
    return {i: (n, sorted(slots)) for i, (n, slots) in out.items()}


def test_every_document_equals_the_plain_version(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None]), rng.choice([0, 1, 5, 40, 200])) for i in range(200)]
    monkeypatch.setattr(mixing, "REACHES", 7)
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r["doc_id"]: (r["taken"], sorted(p["slot"] for p in r["parts"] or [])) for r in collected(mixing.mix(sized, block=37))}
    assert got == brute_mix(spark, rows, 37)


def test_the_schedule_decides_the_slots(spark, monkeypatch):
    texts, sources = [(i, "w " * (50 + i)) for i in range(300)], ["ab"[i % 3 == 0] for i in range(300)]
    columns = lambda: {r["doc_id"]: (r["taken"], r["first_slot"], tuple(r["slots"] or ())) for r in collected(mixing.mix_documents(documents(spark, texts, sources)))}
    before = columns()
    assert any(r["first_slot"] for r in collected(mixing.mix_documents(documents(spark, texts, sources))))
    schedule = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda quotas: schedule(quotas).selectExpr("place", "block", "1000000 - slot AS slot"))
    after = columns()
    assert {i: r[0] for i, r in after.items()} == {i: r[0] for i, r in before.items()}
    assert all(after[i][1] != r[1] for i, r in before.items() if r[0])


def check(spark, texts, sources) -> None:
    df = mixing.mix_documents(documents(spark, texts, sources))
    rows = collected(df)
    sizes = defaultdict(int)
    for (_, t), s in zip(texts, sources):
        sizes[s] += words(t)
    target = brute_targets(dict(sizes))
    expected = sorted(str((i, words(t), sizes[s], round(target[s], 6))) for (i, t), s in zip(texts, sources))
    assert expected == sorted(str((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6))) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == sum(int(t) for t in target.values())
    again = mixing.mix_documents(documents(spark, texts, sources).repartition(3))
    assert sorted(map(str, rows)) == sorted(map(str, collected(again)))


def test_targets_and_words_taken(spark):
    rng = random.Random(4)
    names = ["b", "a", "é", "Z", None, "zz", ""]
    sources = rng.choices(names, [50, 3, 10, 20, 5, 1, 2], k=300)
    check(spark, [(i, "w " * rng.randint(0, 60)) for i in range(300)], sources)


def test_awkward_rows(spark):
    check(spark, AWKWARD, [None, "a", "b", "a", "b", "b", "c", "c", "d", "a", "a"])
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    assert [r["taken"] for r in collected(mixing.mix_documents(documents(spark, [(1, None), (2, "")], ["a", "b"])))] == [0, 0]


def test_schedule_spreads_every_source(spark):
    quotas = spark.createDataFrame([(1, 50), (2, 25), (3, 0), (4, 5)], "place long, quota long")
    rows = collected(mixing.schedule(quotas))
    assert len({r["slot"] for r in rows}) == 80
    for place, quota in ((1, 50), (2, 25), (4, 5)):
        own = sorted((r["slot"], r["block"]) for r in rows if r["place"] == place)
        assert [b for _, b in own] == list(range(quota))
        # Never further than a few slots from an even spacing over the 128 points.
        assert all(abs(slot - (k + 0.5) * 128 / quota) <= 4 * 128 / quota for k, (slot, _) in enumerate(own))


def test_parts_cover_what_is_taken(spark):
    sized = spark.createDataFrame([(i, "ab"[i % 2], 10 + i) for i in range(20)], "doc_id long, source string, size long")
    for r in collected(mixing.mix(sized, block=7)):
        parts = r["parts"] or []
        assert sum(p["last"] - p["first"] for p in parts) == r["taken"]
        assert all(0 <= p["first"] < p["last"] <= r["size"] for p in parts)
