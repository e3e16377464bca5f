"""Exact dedup, source mix and shards, beside plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from kerbline.llm import common, exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, bit string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows], SCHEMA)


ODD = [(1, "Same TEXT", "a"), (2, "same text", "b"), (2, "same text", "b"), (3, None, "a"), (4, "", None),
       (5, "É", "a"), (6, "é", "a"), (7, "word " * 5000, "a"), (8, "WORD " * 5000, "c"), (None, "alone", "a"),
       (None, "shared", "a"), (9, "Shared", ""), (10, " \t\n", "b")]


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_exact_dedup(spark, words):
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[_lower(t)].append(i)
    expected = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    rows = exact_dedup.exact_dedup(_docs(spark, ODD), filter_words=words).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == expected
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    docs = _docs(spark, ODD)
    out = exact_dedup.exact_dedup(docs, carry=docs.columns)
    assert set(out.columns) == {*docs.columns, *exact_dedup.RESULT} and out.count() == len(ODD)
    assert exact_dedup.exact_dedup(_docs(spark, [])).count() == 0


def test_only_possible_repeats_are_shuffled(spark):
    rows = [(i, f"text {i}", "a") for i in range(2000)] + [(5000, "text 7", "a")]
    docs = _docs(spark, rows)
    folded = exact_dedup.fold(exact_dedup.repeated(docs.select(exact_dedup._bit("text").alias("bit"))), 1 << 16)
    hits = exact_dedup.with_hits(docs.select(exact_dedup._bit("text").alias("bit")), "bit", folded, 1 << 16)
    assert 2 <= hits.where("__hit").count() < 10


def _targets(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, list(names), total * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_mix(spark, block):
    rows = [(i, "w " * (i % 37), ("abc"[i % 3] if i % 10 else None)) for i in range(400)] + ODD
    docs = _docs(spark, rows)
    out = mixing.mix_report(docs, block_words=block).collect()
    assert sorted(r.size for r in out) == sorted(len((t or "").split()) for _, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = _targets(sizes)
    assert Counter(round(r.target, 6) for r in out) == Counter(round(expected[s], 6) for _, _, s in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    sums = Counter()
    for r in out:
        sums[r.source_size, r.target] += r.taken
    by_pair = Counter()
    for s, t in expected.items():
        by_pair[sizes[s], t] += round(t)
    for (size, target), taken in sums.items():
        want = sum(v for (a, b), v in by_pair.items() if a == size and abs(b - target) < 1e-6)
        assert abs(taken - want) <= 1
    again = mixing.mix_report(docs.repartition(7), block_words=block)
    assert Counter(map(tuple, out)) == Counter(map(tuple, again.collect()))


def test_mix_slots_and_draws(spark):
    docs = _docs(spark, [(i, "w " * 50, "ab"[i % 2]) for i in range(100)])
    mix = mixing.Mix(docs, block_words=16, shard_slots=40)
    slots = mix.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)
    assert max(Counter((r.sid, r.block) for r in slots).values()) <= 2
    drawn = {(r.shard, r.sid): r.n_blocks for r in mix.drawn.collect()}
    assert drawn == Counter((r.shard, r.sid) for r in slots)
    full = Counter(r.shard for r in slots)
    assert all(sorted(r.slot for r in slots if r.shard == k) == list(range(n)) for k, n in full.items())
    assert sorted(full.values())[1:] == [40] * (len(full) - 1)
    # what documents take is what the slots take
    taken = mix.taken().collect()
    assert sum(r.taken for r in taken) == sum(r["take"] for r in slots)
    assert all((r.first_shard is None) == (r.taken == 0) and (r.first_shard is None or r.first_shard in full) for r in taken)


def test_draws_are_multinomial(spark):
    """Counts of the sources over many shards against the multinomial given the totals: chi-squared, and their spread."""
    docs = _docs(spark, [(i, "w " * 320, "abc"[i % 3]) for i in range(300)])
    mix = mixing.Mix(docs, block_words=8, shard_slots=100)
    counts = defaultdict(Counter)
    for r in mix.drawn.collect():
        counts[r.shard][r.sid] = r.n_blocks
    shards = [c for c in counts.values() if sum(c.values()) == 100]
    totals = sum(counts.values(), Counter())
    share = {s: n / sum(totals.values()) for s, n in totals.items()}
    chi = [sum((c[s] - 100 * p) ** 2 / (100 * p) for s, p in share.items()) for c in shards]
    assert len(shards) > 100
    # two degrees of freedom: mean 2, and 5 % above 5.99
    assert abs(sum(chi) / len(chi) - 2) < 0.6 and sum(x > 5.99 for x in chi) < 0.12 * len(chi)


def test_mixed_texts(spark):
    rows = [(i, f"\ta{i} b{i}\n" + f"w{i} " * (i % 23) + "end \n", "abc"[i % 3]) for i in range(200)]
    docs = _docs(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs, block_words=8).collect()}
    texts = defaultdict(list)
    for r in mixing.mixed_texts(docs, block_words=8).collect():
        texts[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    source = {i: t for i, t, _ in rows}
    assert {i: sum(len(t.split()) for t in ts) for i, ts in texts.items()} == {i: n for i, n in taken.items() if n}
    for i, ts in texts.items():
        whole = Counter(source[i].split())
        assert all(not Counter(t.split()) - whole for t in ts)
        assert all(t == source[i] for t in ts if len(t.split()) == len(source[i].split()))
    assert mixing.mixed_texts(_docs(spark, [])).count() == 0 and mixing.mix_report(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 24, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(common.permuted("id", f"{n}L", "5L").alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_running_sum(spark):
    rows = [(i % 3 if i % 5 else None, i, i % 7) for i in range(30000)]
    df = spark.createDataFrame(rows, "k int, id long, w long")
    got = common.running(df, ["k"], ["id"], "w", "before").collect()
    assert len(got) == len(rows)
    for key in (0, 1, 2, None):
        spans = sorted((r.before, r.before + r.w) for r in got if r.k == key)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_shards(spark):
    rows = ODD + [(i, "x" * (i % 50), "s") for i in range(100, 700)]
    out = sharding.shard_report(_docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(24)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard_report(_docs(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert sharding.shard_report(_docs(spark, [])).count() == 0
