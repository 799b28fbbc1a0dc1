"""Each operator against a brute-force version, with awkward rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, documents, leaks, near, quality_counts, repeats, sentence
from pyspark.sql import functions as F

from contigbin.llm import chat, decontaminate, near_dedup, packing, quality, resampling, sharding, suffix_dedup, token_counts, toxicity
from contigbin.llm.tokens import encoder, public_path

ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    """Spread over partitions, with columns whose names the operators use themselves."""
    clashing = {c: F.lit(f"own {c}") for c in ("kept", "score", "n", "th", "at", "rep", "label", "token", "salt", "length", "start", "w", "doc", "shard")}
    return spark.createDataFrame(ROWS, DOCS).repartition(5).withColumns(clashing)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("limit", [1, 2_000, 30_000, 10**9])
def test_sharding_fits_and_splits_only_what_is_too_large(docs, limit):
    sized = docs.select("doc_id", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = sharding.shard(sized, F.col("doc_id"), F.col("n_bytes"), limit).collect()
    codes = {d: format(int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), "060b") for d, *_ in ROWS}
    size = {d: len((t or "").encode()) for d, t, *_ in ROWS}

    def leaf(code):
        for depth in range(61):
            inside = [d for d in codes if codes[d].startswith(code[:depth])]
            if len(inside) == 1 or sum(size[d] for d in inside) <= limit:
                return code[:depth]

    assert {r["doc_id"]: r["shard"] for r in rows} == {d: leaf(c) for d, c in codes.items()}
    for r in rows:
        assert r["shard_depth"] == len(r["shard"]) and (r["shard_bytes"] <= limit or r["shard_rows"] == 1) and r["oversize"] == (r["shard_bytes"] > limit)


def test_sharding_splits_one_key_and_equal_rows(spark, empty):
    same = spark.range(200).select(F.lit(7).alias("doc_id"), F.lit(None).cast("string").alias("key"), F.lit(100).alias("n"))
    rows = sharding.shard(same, F.col("key"), F.col("n"), 1_000).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 100
    assert len(rows) == 200 and max(sizes.values()) <= 1_000 and min(map(len, sizes)) > 60
    assert sharding.shard(empty, F.col("doc_id"), F.col("n_chars")).count() == 0


def test_sharding_keeps_columns_named_like_its_own(spark):
    names = ["_bytes", "_hash", "_base", "_lead", "_prefix", "_depth", "_size", "_n", "_row", "row", "depth", "node"]
    mine = spark.range(60).select(F.col("id").alias("doc_id"), *(F.lit(f"own {n}").alias(n) for n in names), F.lit("gone").alias("shard"))
    rows = sharding.shard(mine, F.col("doc_id"), F.lit(100), 500).collect()
    assert len(rows) == 60 and all(r[n] == f"own {n}" for r in rows for n in names) and len({r["shard"] for r in rows}) > 10


def test_quality_counts_and_verdicts(docs, empty):
    got = by_id(quality.assess(docs))
    for doc, text, *_ in ROWS:
        r, counts = got[doc], quality_counts(text)
        assert tuple(r)[1:6] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.assess(empty).count() == 0 and quality.clean(empty).columns == empty.columns


def test_quality_removes_failing_lines_only(spark):
    rng = random.Random(3)
    good = [sentence(rng, 20).capitalize() for _ in range(6)]
    bad = ["Home | News | Sport | About", "Accept all cookies to go on.", "### *** $$$ %%% &&&", "MENU", good[0]]
    text = "\n".join([good[0], *bad[:4], *good[1:], bad[4]])
    cleaned = quality.clean(spark.createDataFrame([(1, text, "x"), (2, "\n".join([*bad[:4]] * 20 + good[:2]), "y")], "doc_id long, text string, kept string")).collect()
    assert [(r["doc_id"], r["text"], r["kept"]) for r in cleaned] == [(1, "\n".join(good), "x")]


def test_quality_phrases_are_whole_words_of_short_lines(spark):
    prose = "The design in a second phase spread more light on the empowered by law and its makers, as they said."
    long = " ".join([prose] * 20) + " You may read more of it here."
    assert quality.judge(long)[1] == long and quality.judge(prose)[0][-2:] == (0, 0)
    assert quality.judge("Please sign in to read more!")[0][-2] == 1 and quality.judge("© 2020 All rights reserved.")[0][-2] == 1
    text = "\n".join(sentence(random.Random(k), 20) for k in range(5))
    rows = quality.assess(spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in rows) == [("1", True), ("1", True), ("None", False), ("None", True)]


def test_decontamination_equals_brute_force(spark, docs, empty):
    rng = random.Random(5)
    texts = {d: t for d, t, *_ in ROWS}
    items = [(0, texts[2]), (1, sentence(rng, 30)), (2, " ".join(texts[1].split()[:25])), (3, None), (4, ""), (5, "Only three words"), (6, texts[2])]
    changed = texts[4].split()
    items.append((7, " ".join([*changed[:3], "other", *changed[4:40]])))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, benchmark).collect()}
    want = leaks(ROWS, items)
    assert got == pytest.approx(want) and want
    held = {d for d, _ in want}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, benchmark).select("doc_id").collect()) == sorted(set(texts) - held)
    assert decontaminate.matches(empty, benchmark).count() == 0 == decontaminate.matches(docs, benchmark.limit(0)).count()


@pytest.mark.parametrize("n,ends,added", [(59, 1, 2), (200, 8, 16)])
def test_decontamination_tries_starts_that_no_anchor_sets(spark, n, ends, added):
    """Both ends replaced and words inserted in the middle: the best window starts between the anchored ones."""
    item = [f"w{k}" for k in range(n)]
    other = lambda name, many: [f"{name}{k}" for k in range(many)]
    text = other("before", 30) + other("head", ends) + item[ends : n // 2] + other("mid", added) + item[n // 2 : n - ends] + other("tail", ends) + other("after", 30)
    rows, items = [(1, " ".join(text))], [(7, " ".join(item))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks([(1, " ".join(text), "", "", 0)], items)
    assert list(want) == [(1, 7)] and got == pytest.approx(want)


@pytest.mark.parametrize("n,heavy", [(180, 20), (100, 12), (150, 16), (70, 8)])
def test_decontamination_finds_items_with_repeated_shingles(spark, n, heavy):
    """Blanks, dot leaders and repeated tokens: one shingle many times, which must not decide the fingerprint."""
    rng = random.Random(n)
    rows, items = [], []
    for k in range(20):
        own = [f"i{k}w{j}" for j in range(n)]
        rows.append((k, " ".join([f"x{rng.random()}" for _ in range(30)] + own + ["."] * heavy + [f"y{rng.random()}" for _ in range(9)])))
        items.append((k, " ".join(own + ["_"] * heavy)))
        rows.append((100 + k, " ".join(own[:-3] + [f"z{j}" for j in range(3)] + ["_"] * heavy)))
    want = leaks([(*r, "", "", 0) for r in rows], items)
    assert len(want) >= 20
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == pytest.approx(want)


def test_decontamination_fingerprints_number_repeated_shingles(spark):
    """The rolling fingerprint of every window equals that of its features made from scratch."""
    rng = random.Random(8)
    hashes = [rng.choice([rng.getrandbits(62), 5, 7, 9 << 40]) for _ in range(60)]
    n, row = 20, spark.createDataFrame([(hashes,)], "hs array<long>")
    again = row.withColumn("again", decontaminate.repeated(F.col("hs")))
    once = F.transform("hs", lambda h: F.when(F.array_contains("again", h), F.lit(0).cast("bigint")).otherwise(h))
    repeats = F.filter(F.transform("hs", lambda h, p: F.struct(p.alias("p"), h.alias("h"))), lambda e: F.array_contains("again", e["h"]))
    prepared = again.select("hs", decontaminate.running_sums(once, 16).alias("sums"), repeats.alias("repeats"))
    rolled = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda at: decontaminate.window_simhash(F.col("sums"), at, F.lit(n), 16, decontaminate.counters(decontaminate.numbered_within(F.col("repeats"), at, F.lit(n)), 16)))
    fresh = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda at: decontaminate.simhash(decontaminate.features(F.slice("hs", at + 1, n))))
    got = prepared.select(rolled.alias("a"), fresh.alias("b")).first()
    assert got["a"] == got["b"] and len(set(got["a"])) > 10


def test_decontamination_finds_items_in_another_order(spark):
    """B + A of an item A + B, with and without words around; equal ids with different texts; null ids; repeated shingles."""
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    around = [f"x{k}" for k in range(300)]
    loop = ["to", "and", "fro"] * 25
    rows = [(1, b + a), (2, around + b + a + around), (3, around), (4, around + a + b), (5, loop + around), (5, around[:9]), (None, a + b)]
    items = [(7, " ".join(a + b)), (8, " ".join(loop[:60])), (9, " ".join((a + b)[:3]))]
    texts = [(k if k is not None else -5, " ".join(w), "", "", 0) for k, w in rows]
    want = leaks([t for t in texts if t[0] != 5], items) | leaks([texts[4]], items)
    docs = spark.createDataFrame([(k, " ".join(w), "own") for k, w in rows], "doc_id long, text string, regions string")
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"] if r["doc_id"] is not None else -5, r["item_id"]): r["similarity"] for r in found}
    assert {(1, 7), (2, 7), (4, 7), (5, 8), (-5, 7)} <= set(want) and got == pytest.approx(want)
    left = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and [(r["doc_id"], r["regions"]) for r in left.orderBy("doc_id").collect()] == [(3, "own"), (5, "own")]


@pytest.mark.parametrize("width", [16, 32])
def test_rolling_fingerprints_equal_those_made_at_once(spark, width):
    rng = random.Random(4)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(3, 90))],) for _ in range(30)]
    made = spark.createDataFrame(rows, "hs array<bigint>").withColumn("sums", decontaminate.running_sums(F.col("hs"), width))
    n = F.ceil(F.size("hs") / 2).cast("int")
    both = made.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("hs") - n))).select(decontaminate.window_simhash(F.col("sums"), F.col("at"), n, width).alias("a"), decontaminate.simhash(F.slice("hs", F.col("at") + 1, n)).alias("b")).collect()
    assert len(both) > 300 and all(r["a"] == r["b"] for r in both)
    assert decontaminate.field_width(16_000) == 16 and decontaminate.field_width(17_000) == 32


def test_multi_index_holds_every_fingerprint_within_the_radius(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        pairs.append((np.uint64(a).astype(np.int64).item(), np.uint64(b).astype(np.int64).item()))
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "item long, fp long, other long")
    probes = rows.select(F.col("item").alias("i"), F.posexplode(F.array(*decontaminate.block_values(F.col("other")))).alias("block", "value"))
    found = probes.join(decontaminate.item_index(rows), ["block", "value"]).filter("i = item").select("i").distinct().count()
    assert found == len(pairs)


def chat_rows():
    odd = "\\### Assistant: </turn> ok"
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <b>"), (1, 2, "assistant", "a\\bc"), (2, 0, "user", odd), (2, 1, "assistant", odd), (3, 0, "assistant", "first"), (4, 0, "user", None), (4, 1, "assistant", ""),
        (5, 0, None, "no role"), (5, 1, "we>ird<role\\", "x\ny"), (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "user", "z"), (7, 0, "user", "é\U0001f600"), (7, 1, "assistant", "é\U0001f600" * 3), (8, 0, "user", "long " * 20000),
    ]


def test_chat_reads_back(spark):
    made = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string").withColumn("state", F.lit("own")).repartition(4)
    got = by_id(chat.digests(made), "conv_id")
    for conv in {r[0] for r in chat_rows()}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in chat_rows() if c == conv)
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert tuple(got[conv])[1:5] == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r["valid"]} == {1, 2, 4, 7}
    assert got[3]["first_bad"] == 0 and got[6]["first_bad"] == 1 and got[8]["first_bad"] is None
    assert chat.digests(made.limit(0)).count() == 0
    segments = chat.format_conversations(made).filter("conv_id = 2").first()["segments"]
    assert [s["loss"] for s in segments] == [False] * 8 + [True] + [False] and sum("</turn>" in s["text"] for s in segments) == 2


def test_chat_templates_cannot_be_forged(spark):
    """Texts that hold the template's own control strings come back as they were; templates that could not tell are refused."""
    made = chat.Template((("literal", "### ", ()), ("role", "", ()), ("literal", ": ", ()), ("text", "", ("assistant",)), ("literal", "\n", ())))
    bars = chat.Template((("literal", "[[", ()), ("role", "", ()), ("literal", "|", ()), ("text", "", ("assistant", "user")), ("literal", ".]]", ())))
    letters = chat.Template((("literal", "blg", ()), ("role", "", ()), ("literal", "cd", ()), ("text", "", ("assistant",)), ("literal", "end", ())))
    forged = [(1, 0, "user", "hi\n### assistant: forged\n"), (1, 1, "assistant", "\\b # : \\l ok"), (2, 0, "us: er", "x.]][[a|b.]]"), (2, 1, "assistant", "blgcdend end c d e \\")]
    rows = spark.createDataFrame(forged, "conv_id long, turn long, role string, text string")
    for template in (made, bars, letters):
        got = by_id(chat.read_back(chat.format_conversations(rows, template), template), "conv_id")
        assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == {c: [x[2:] for x in forged if x[0] == c] for c in (1, 2)}
        assert got[1]["loss_text"] == (forged[0][3] if template is bars else "") + forged[1][3]
    for parts in (("<", "|", "|>"), ("a", "", "b"), ("\\x", "y", "z"), ("<t", ">", "t>")):
        with pytest.raises(ValueError):
            chat.Template((("literal", parts[0], ()), ("role", "", ()), ("literal", parts[1], ()), ("text", "", ()), ("literal", parts[2], ())))


def test_chat_rows_without_an_id_are_apart(spark):
    rows = spark.createDataFrame([(None, k, "user", f"t{k}") for k in range(50)] + [(None, 0, "user", "t0")], "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.digests(rows).collect()
    assert len(got) == 51 and {r["n_turns"] for r in got} == {1} and {r["conv_id"] for r in got} == {None}


def plain_sections(text, lengths, sections):
    """Of each section (-1: none): tokens, and those that cross a boundary; token by token, character by character."""
    data, out, at, char_of = text.encode(), {}, 0, []
    for i, c in enumerate(text):
        char_of += [i] * len(c.encode())
    owner = {}
    for k, (a, b) in enumerate(sections):
        owner |= dict.fromkeys(range(a, b), k)
    for n in lengths:
        chars = sorted({char_of[j] for j in range(at, at + n) if data[j] & 0xC0 != 0x80})
        whole = bool(chars)
        chars = chars or [char_of[at]]
        held = Counter(owner.get(c, -1) for c in chars)
        best = min((k for k in held if k >= 0), key=lambda k: (-held[k], k), default=-1)
        tokens, edge = out.get(best, (0, 0))
        out[best] = tokens + 1, edge + (whole and len(held) > 1)
        at += n
    return out


def test_token_counts_by_section_equal_brute_force(spark, docs):
    cut = lambda text: np.array([(a, min(a + 5, len(text))) for a in range(2, len(text), 7)], np.int64).reshape(-1, 2)
    enc = encoder()
    for sections in (token_counts.lines, cut):
        got = {}
        for r in token_counts.count(docs, sections).collect():
            got.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"], r["n_boundary"]
        for doc, text, *_ in ROWS:
            text = text or ""
            want = plain_sections(text, enc.lengths[enc.ids(text)].tolist(), sections(text).tolist())
            assert {k: v for k, v in got.get(doc, {}).items() if v[0]} == want, doc
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count(same).collect()) == [("1", 2), ("1", 2), ("None", 0), ("None", 1)]


def test_token_counts_partition_every_token(docs, empty):
    rows, enc = token_counts.count(docs).collect(), encoder()
    texts = {d: t or "" for d, t, *_ in ROWS}
    for doc, text in texts.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == len(enc.ids(text)) and "".join(text[r["start"] : r["start"] + r["n_chars"]] for r in own) == text
    assert token_counts.count(empty).count() == 0


def test_tokens_at_boundaries_go_to_most_characters_then_first():
    start, end = np.array([0, 2, 5, 9, 9]), np.array([2, 5, 9, 9, 12])
    sections = np.array([[0, 3], [3, 7], [7, 10]])
    where, crossing = token_counts.allocate(start, end, sections)
    assert where.tolist() == [0, 1, 1, 2, 2] and crossing.tolist() == [False, True, True, False, True]
    assert token_counts.allocate(np.array([20]), np.array([22]), sections)[0].tolist() == [-1]


def test_fast_ids_equal_those_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for _, text, *_ in [*ROWS, (0, "<|endoftext|> x", 0, 0, 0), (0, "\U0001f600 don't  \t\n 123abc", 0, 0, 0), (0, "\n" * 1_000_000 + "a", 0, 0, 0)]:
        assert encoder().ids(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_whole_and_tight(docs, empty, capacity):
    rows = packing.pack(docs, capacity).collect()
    enc, used = encoder(), {}
    for doc, text, *_ in ROWS:
        ids, at = np.append(enc.ids(text or ""), np.uint32(1)).astype("<u4"), 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= capacity
    assert sorted(used) == list(range(len(used)))
    assert packing.pack(empty).count() == 0


def test_packing_of_rows_that_repeat_or_have_no_id(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b c " * 30), (1, "a b c " * 30), (None, "x"), (None, None)], "doc_id long, text string"), 16).collect()
    n = len(encoder().ids("a b c " * 30)) + 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * n and sorted(r["doc_tokens"] for r in rows if r["doc_id"] is None) == [1, 2]
    full = [r["sequence_id"] for r in rows if r["length"] == 16]
    assert len(set(full)) == len(full) == 2 * (n // 16) and sorted({r["sequence_id"] for r in rows})[-len(full) :] == sorted(full)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    lengths = [rng.randint(1, 64) for _ in range(3_000)] + [64] * 50 + [33] * 400
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(64 - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    made, left = packing.plan(counts, 64), {}
    for length, _, n, each, first, step, _ in made.tolist():
        for k in range(n // each):
            left[first + k * step] = left.get(first + k * step, 64) - each * length
    assert sorted(left.values()) == sorted(rooms)


def test_resampling_is_exact_top_k(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    for share in (0.0, 0.3, 1.0):
        rows = resampling.resample(docs, labels, share=share).collect()
        keys = sorted((r["key"] for r in rows), reverse=True)
        k = round(share * len(rows))
        assert len(rows) == len(ROWS) and {r["doc_id"] for r in rows if r["kept"]} == ({r["doc_id"] for r in rows if r["key"] >= keys[k - 1]} if k else set())
    weights = by_id(resampling.resample(docs, labels))
    assert all(weights[d]["log_weight"] == 0 and weights[d]["n_grams"] == 0 for d, t, *_ in ROWS if not (t or "").split())
    assert resampling.resample(empty, labels).count() == 0 and resampling.resample(docs, labels.limit(0)).count() == len(ROWS)


def test_log_weights_equal_brute_force(spark, docs):
    """The sum over unigrams and bigrams of log(target / raw), with counts made one by one."""
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    from contigbin.llm.common import shingle_hashes, utf8, word_hashes

    grams = {}
    for doc, text, *_ in ROWS:
        h, _ = word_hashes(*utf8(pa.array([text])))
        grams[doc] = [int(x >> np.uint64(32)) % resampling.BUCKETS for x in [*h, *shingle_hashes(h, 2)]]
    raw = Counter(g for x in grams.values() for g in x)
    target = Counter(g for d, x in grams.items() if d < 40 and d % 2 == 0 for g in x)
    n_raw, n_target = sum(raw.values()) + resampling.BUCKETS, sum(target.values()) + resampling.BUCKETS
    want = {d: sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in x) for d, x in grams.items()}
    got = by_id(resampling.resample(docs, labels))
    assert {d: r["log_weight"] for d, r in got.items()} == pytest.approx(want) and {d: r["n_grams"] for d, r in got.items()} == {d: len(x) for d, x in grams.items()}
    mean = by_id(resampling.resample(docs, labels, per_grams=100.0))
    assert {d: r["log_weight"] for d, r in mean.items()} == pytest.approx({d: 100 * w / max(1, len(grams[d])) for d, w in want.items()})


def test_resampling_keeps_ties_and_rows_that_repeat(spark):
    rows = [(7, "one two three")] * 30 + [(None, "four five")] * 10 + [(8, "six")]
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=0.5).collect()
    assert len(got) == 41 and len({(r["doc_id"], r["key"]) for r in got}) == 3 and all(len({r["kept"] for r in got if r["doc_id"] == d}) == 1 for d in (7, 8, None))


def test_kth_greatest_refines(spark):
    rows = spark.range(20_000).select((F.col("id") % 7_000 / 3.0).alias("key"))
    values = sorted((k % 7_000 / 3.0 for k in range(20_000)), reverse=True)
    for k in (1, 2, 777, 19_999, 20_000):
        assert resampling.kth_greatest(rows, "key", k) == values[k - 1]


@pytest.mark.parametrize("hot,length", [(8_192, 100), (2, 100), (8_192, 151), (2, 200), (8_192, 24)])
def test_suffix_dedup_equals_brute_force(docs, empty, monkeypatch, hot, length):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = repeats(ROWS, length)
    assert {d: tuple(r)[1:] for d, r in by_id(suffix_dedup.dedup(docs, length)).items()} == {d: x[:4] for d, x in want.items()}
    if length != 100:
        return
    cut = by_id(suffix_dedup.cut(docs))
    assert {d: r["kept"] for d, r in cut.items()} == {d: "own kept" for d in want}
    for doc, text, *_ in ROWS:
        if (text or "").isascii():
            assert (cut[doc]["text"] or "").encode() == want[doc][4] and (cut[doc]["text"] is None) == (text is None)
    assert suffix_dedup.dedup(empty).count() == 0 and suffix_dedup.cut(empty).columns == empty.columns


def test_suffix_dedup_of_rows_that_repeat(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, text), (1, text), (2, text[50:250]), (None, text[100:290]), (3, text[:99]), (4, None), (4, None)]
    got = [(r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 190), (1, 190), (2, 200), (None, 0), (3, 0), (4, 0), (4, 0)], key=str)


def test_suffix_dedup_keeps_texts_of_one_id_apart(spark):
    """Thousands of texts under one doc_id and under none: each loses the passage that another has before it."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdef") for _ in range(150))
    rows = [(k % 2 or None, "".join(rng.choice("ghij") for _ in range(40 + k % 7)) + passage) for k in range(400)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got)[:1] == [0] and sum(r["n_removed"] == 0 for r in got) == 1 and all(not r["n_removed"] or 150 <= r["n_removed"] <= 165 for r in got)


@pytest.mark.parametrize("length", [23, 5_000])
def test_suffix_dedup_refuses_lengths_it_cannot_count(empty, length):
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.dedup(empty, length)


def test_levels_are_in_byte_order_and_keep_the_first_of_each():
    rng, levels, seen, gone = np.random.default_rng(3), suffix_dedup.SuffixLevels(), {}, set()
    for _ in range(40):
        n = int(rng.integers(1, 200))
        prefix = np.array([b"%06d" % k + bytes(2) + b"x" for k in rng.integers(0, 900, n)], "S9")
        start = rng.integers(0, 1 << 40, n)
        d, t, s = levels.add(prefix, start % 97, start % 5, start)
        for k, x in zip(prefix.tolist(), start.tolist(), strict=True):
            seen.setdefault(k, set()).add((x % 97, x % 5, x))
        gone |= set(zip(d.tolist(), t.tolist(), s.tolist(), strict=True))
    assert gone == {x for xs in seen.values() for x in xs if x != min(xs)}
    sizes = [len(x[0]) for x in levels.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and all((x[0][1:] > x[0][:-1]).all() for x in levels.levels)


@pytest.mark.parametrize("size,small,block", [(4, 64, 2048), (5, 64, 2048), (4, 2, 4), (5, 1, 3)])
def test_near_dedup_equals_brute_force(docs, empty, monkeypatch, size, small, block):
    """Small limits send lists through hubs, later links and blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    want = near(ROWS, size)
    got = by_id(near_dedup.near_duplicates(docs, size))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d][1]) for d, r in got.items())
    if small == 64:
        kept = near_dedup.keep_one(docs, size)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d, (_, c) in want.items() if c == d)
        assert near_dedup.near_duplicates(empty, size).count() == 0


def test_near_dedup_of_rows_that_repeat(spark):
    text = sentence(random.Random(4), 30)
    rows = [(5, text), (5, text), (9, text), (None, text), (None, None)]
    got = [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()]
    assert sorted(got, key=str) == sorted([(5, 27, 5, True), (5, 27, 5, True), (9, 27, 5, False), (None, 27, None, True), (None, 0, None, True)], key=str)


def test_near_dedup_keeps_one_of_equal_rows(spark, monkeypatch):
    """Rows of one doc_id and text are one; other texts under that id are judged by themselves; lists are split by bytes."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 400)
    rng = random.Random(4)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    near_a = [a.rsplit(" ", 1)[0] + f" end{k}." for k in range(9)]
    rows = [(5, a, "x"), (5, a, "y"), (6, a, "z"), (6, b, "z"), (7, c, "z"), (7, c, "z"), (None, a, "n"), *((10 + k, t, "near") for k, t in enumerate(near_a))]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, th string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["th"]) for r in kept) == sorted([(5, a, "x"), (6, b, "z"), (7, c, "z"), (0, a, "n")])


def test_words_longer_than_a_table_of_powers_differ():
    from contigbin.llm.common import utf8, word_hashes

    x, y = "a" * 65_536, "b" * 65_536
    h, first = word_hashes(*utf8(pa.array([x + y, y + x, " " * 70_000 + "c", "c"])))
    assert len(set(h[:2].tolist())) == 2 and h[2] == h[3] and first.tolist() == [0, 1, 2, 3, 4]


def test_toxicity_trains_on_a_bounded_number_of_rows(spark):
    docs = spark.createDataFrame([(k % 2 + 1, f"text {k}") for k in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, toxic int, quality int")
    for n in (1, 2, 10):
        assert toxicity.training_rows(docs, labels, "toxic", 5, 4, n).count() == min(n, 2)
    scored = toxicity.classify(docs, labels).collect()
    assert len(scored) == 501 and all(0 <= r["score"] <= 1 for r in scored)


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        w = sentence(rng, 40).split()
        bad = k % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(40)] = rng.choice(["Vilefool", "grumpwit", "nastig"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad), 0))
    corpus = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(3)).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = by_id(toxicity.classify(corpus, known))
    assert {d for d, r in got.items() if r["held_out"]} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    held = [(r["predicted"], labels[d][1]) for d, r in got.items() if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    scored = by_id(toxicity.classify(docs, known.limit(0)))
    assert len(scored) == len(ROWS) and {r["score"] for r in scored.values()} == {0.5}
    assert toxicity.classify(empty, known).count() == 0
    odd = toxicity.score(docs, toxicity.fit(corpus, known)).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
