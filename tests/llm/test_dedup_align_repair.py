"""Exact duplicates, tokenizer alignment and conversation repair against plain versions."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import FOLDER, LONG, SCHEMA, awkward, awkward_rows, counted, documents, empty, texts  # noqa: F401

from tabloom.llm import alignment, dedup, fuse, repair
from tabloom.llm.queries import QUERIES, alignment_files, damaged

# Fuse filters


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_fuse_filter_loses_nothing(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    held = fuse.build(np.concatenate([keys, keys]))
    assert held.passes(keys).all() and all(int(k) in held for k in keys[:3])
    others = np.random.default_rng(n + 1).integers(-(2**63), 2**63 - 1, 50_000)
    assert held.passes(others).mean() < 0.008
    assert len(held.cells) <= max(64, 2 * n)


# 11 exact duplicates


def _classes(df, **options):
    found = dedup.deduplicate(df, dedup.by_arrival(), dedup.BATCHES, **options)
    return counted(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("bits", [64, 2])
def test_duplicates(awkward, bits):  # noqa: F811
    """With digests of two bits nearly all texts collide, in the filters, the buckets and the batches."""
    assert _classes(awkward.withColumn("sha", F.lit(1)).withColumn("batch", F.lit("x")), bits=bits) == counted(brute.duplicates(texts(awkward)))


def test_duplicates_of_documents(spark, documents):  # noqa: F811
    rows = QUERIES["op11_fuse_filter_dedup"](spark, FOLDER).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert counted(map(tuple, rows)) == counted(brute.duplicates(texts(documents)))
    assert any(not r.kept for r in rows)


def test_a_third_of_all_rows_is_one_text(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("h o\t"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")), F.lit("t"))).otherwise(
            F.concat(F.lit("t"), F.col("id") % 1999)
        ).alias("text"),
    )
    assert _classes(df) == counted(brute.duplicates(texts(df)))


def test_snapshot_answers_by_bytes(spark):
    """A digest two texts share passes the filter, meets its bucket and is refused there."""
    old = spark.createDataFrame([(f"old {i}",) for i in range(40)], "text string")
    new = spark.createDataFrame([(f"new {i}",) for i in range(40)] + [("old  7",)], "text string")
    before, after = dedup.take_snapshot(old, 40, bits=3), dedup.take_snapshot(new, 41, bits=3)
    digests = after.exact.select("digest")
    passed = dedup.screen(digests, before, 41)
    assert passed.count() == digests.count()
    (found,) = dedup.confirm(passed, after, before).collect()
    assert found.sha == brute.sha("old7")


def test_texts_stay_in_their_buckets(spark):
    df = spark.range(50).select(F.concat(F.lit("x"), "id").alias("text"))
    old, new = dedup.take_snapshot(df, 50), dedup.take_snapshot(df, 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        possible = dedup.screen(new.exact.select("digest"), old, 50).distinct()
        plan = dedup.confirm(possible, new, old)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Between the texts' scans and the joins there is no exchange; only the screened digests have some.
    above = plan[: plan.index("FlatMapCoGroups")]
    assert plan.count("Bucketed: true") >= 2 and above.count("Exchange hashpartitioning(digest") <= 2 and "texts" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line
    )


# 12 alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment_files())


def _plain(text, t):
    return brute.aligned(text, t.a, t.b, t.a_bytes, t.b_bytes)


def test_engines_agree_on_plain_characters(tokenizers):
    for c in [*range(1, 0x80), *range(0xC0, 0x250)]:
        for s in (f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}. {chr(c)}'s it'{chr(c)}", f"\n{chr(c)} \t{chr(c)}  {chr(c)}"):
            assert tokenizers.ranked.encode_ordinary(s) == tokenizers.a.encode(s, add_special_tokens=False).ids


def test_chunks_give_whole_texts():
    pieces = [*"abcE12 .,'  \n\t-_<|>é", "ß", "漢", "😀", " ", "́", "▁", "　", "\x1c", "\x85", "ﬁ", "\x00", "<s>", "</s>", "<unk>",
              "<0x41>", "<|endoftext|>", "it's", " the", " Über", "  ", " "]
    lot = random.Random(4)
    bodies = ["".join(lot.choice(pieces) for _ in range(lot.randint(0, 24))) for _ in range(1500)]
    bodies += ["".join(lot.choice(["word", " ", "  ", "\n", " \n", "é", "naïve ", ". ", "’"]) for _ in range(30)) for _ in range(500)]
    bodies += ["a" * 5000, " " * 300, "漢字" * 800, LONG]
    aligner = alignment.Aligner(alignment_files())
    rows, keys, links = aligner.documents(bodies, 5)
    want = [_plain(b, aligner.t) for b in bodies]
    assert rows == [w[0] for w in want] and sum(r[0] > 0 for r in rows) > 200
    postings = {(i + 5, *pair): n for i, (_, found) in enumerate(want) for pair, n in found.items()}
    mask = (1 << alignment.B_SHIFT) - 1
    assert {(k & 0xFFFF, k >> 16 >> alignment.B_SHIFT, k >> 16 & mask): n for k, n in zip(keys.tolist(), links.tolist())} == postings
    held = alignment.planes(keys, links).to_pylist()
    again = Counter()
    for row in held:
        documents = set()
        for k, one in enumerate(row["planes"]):
            documents |= set(alignment.members(one).tolist())
            again.update({(d, row["a"], row["b"]): 1 << k for d in alignment.members(one).tolist()})
        assert row["n_docs"] == len(documents)
    assert again == postings and sum(r["n_links"] for r in held) == sum(postings.values())


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 5000, 65536])
def test_bitmaps(n):
    some = np.sort(np.random.default_rng(n).permutation(65536)[:n])
    held = alignment.bitmap(some)
    assert len(held) == min(2 * n, 8192) and alignment.members(held).tolist() == some.tolist()


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_alignment(which, request, tokenizers, monkeypatch):
    df = request.getfixturevalue(which)
    if which == "awkward":
        df = df.unionByName(df.where("doc_id IN (4, 11, 14)")).withColumn("block", F.lit("x")).withColumn("number", F.lit("y")).coalesce(1)
    # Small slices and blocks: their bitmaps have to be merged and their counts to be summed.
    monkeypatch.setattr(alignment, "SLICE_CHARS", 5_000)
    monkeypatch.setattr(alignment, "BLOCK_DOCUMENTS", 7 if which == "awkward" else 65536)
    rows = texts(df)
    found, pairs = alignment.align(df, alignment_files())
    want = [(i, *_plain(t, tokenizers)) for i, t in rows]
    count, links, most = Counter(), Counter(), defaultdict(int)
    for _, _, linked in want:
        count.update(linked.keys())
        links.update(linked)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    table = {(r.a, r.b): (r["count"], r.links, r.best) for r in pairs.collect()}
    assert table == {p: (n, links[p], n == most[p[0]]) for p, n in count.items()}
    results = []
    for i, figures, linked in want:
        best = sum(n for p, n in linked.items() if count[p] == most[p[0]])
        results.append((i, *figures[:4], best, sum(n * count[p] for p, n in linked.items()), figures[4]))
    assert counted(map(tuple, found.collect())) == counted(results)


# 13 conversation repair


def _random_rows(lot, n):
    letters = lot.choice(["ua", "sua", "suax", "u", "a", "s", "x", "ux"])
    rows = [(lot.choice(letters), lot.random() < 0.2, lot.random() < 0.3) for _ in range(n)]
    return [(a, must, cut and not must) for a, must, cut in rows]


def test_search_finds_the_first_cheapest_edits():
    lot = random.Random(5)
    for _ in range(1500):
        rows = _random_rows(lot, lot.randint(0, 14))
        want = brute.cheapest_edits(rows)
        ((cost, _, audit),) = repair.search(rows, {repair.START: (0, "")}).values()
        assert (cost, audit) == want
        size = lot.randint(1, 5)
        parts = [rows[i : i + size] for i in range(0, len(rows), size)] or [[]]
        state = {repair.START: (0, "")}
        for k, part in enumerate(parts):
            ends = repair.search(part, state, k == len(parts) - 1)
            state = {place: (c, state[entry][1] + audit) for place, (c, entry, audit) in ends.items()}
        assert list(state.values()) == [want]


def test_edits_of_all_short_conversations():
    """Every audit over up to three rows, tried out."""
    import itertools
    import re

    for n in range(4):
        for rows in itertools.product([("s", False, False), ("u", False, True), ("a", False, False), ("x", True, False)], repeat=n):
            best = None
            for letters in itertools.product("KRDI", repeat=n + 3):
                for size in range(n + 4):
                    audit = letters[:size]
                    if len([x for x in audit if x != "I"]) != n:
                        continue
                    made, cost, i = "", 0, 0
                    for x in audit:
                        turn = "a" if made[-1:] == "u" else "u"
                        if x == "I":
                            made, cost = made + turn, cost + 3
                            continue
                        initial, must, cut = rows[i]
                        i += 1
                        if x == "D":
                            cost += 4
                        else:
                            cost += 99 * must + 3 * cut + 3 * (x == "R")
                            made += initial if x == "K" else turn
                    if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, "".join(audit)) < best):
                        best = (cost, "".join(audit))
            ((cost, _, audit),) = repair.search(list(rows), {repair.START: (0, "")}).values()
            assert (cost, audit) == best == brute.cheapest_edits(rows)


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def conversations(spark):
    """NULLs in every column, repeated rows, equal turns, foreign roles, and one long conversation."""
    lot = random.Random(8)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, 1, None, "x."), (2, 0, "", " \n"), (2, 0, "", " \n")]
    for conv in range(3, 160):
        at = lot.randint(-3, 5)
        for _ in range(lot.randint(1, 9)):
            role = lot.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "stranger", None])
            body = lot.choice(["Yes.", "No!", "why?", "cut off", "Yes. \n", "", "\t", None, " ", "x" * 3000 + "."])
            rows.append((conv, lot.choice([at, at, None]), role, body))
            at += lot.randint(0, 2)
    for at in range(1500):
        rows.append((1000, at, lot.choice(["user", "assistant"]), f"{at} said{lot.choice(['.', '!', ''])}"))
        rows.append((1001, at, "tool", f"{at}."))
    return spark.createDataFrame(rows, CONVERSATION)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3])
def test_repair(conversations, segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    table = conversations.withColumn("blank", F.lit("x")).withColumn("duplicate", F.lit("y")).withColumn("copy", F.lit("z"))
    rows = [tuple(r) for r in conversations.collect()]
    got = repair.repair(damaged(table), gone=F.col("gone"), with_turns=True).collect()
    want = {conv: brute.repaired(found) for conv, found in brute.damage(rows).items()}
    assert {r.conv_id: tuple(r)[1:9] for r in got} == want and len(got) == len(want)
    for r in got:
        assert brute.sha("\n".join(f"{t.role}:{t.text}" for t in r.turns)) == r.repaired_sha256


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in QUERIES["op13_branch_and_bound_repair"](spark, FOLDER).select(*NAMES).collect()}
    assert got == {(conv, *brute.repaired(found)) for conv, found in brute.damage(rows).items()}


def test_dropped_rows_leave_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", True), (1, 1, "user", "y", True)], CONVERSATION + ", gone boolean")
    assert [tuple(r) for r in repair.repair(df, gone=F.col("gone")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", brute.sha(""))]


# Empty tables


def test_nothing_comes_of_nothing(spark, empty):  # noqa: F811
    found, pairs = alignment.align(empty, alignment_files())
    none = repair.repair(damaged(spark.createDataFrame([], CONVERSATION)), gone=F.col("gone"))
    assert [df.count() for df in (dedup.deduplicate(empty, dedup.by_arrival(), 2), found, pairs, none)] == [0] * 4
