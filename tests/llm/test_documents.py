import base64
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tellstone.llm.bytepairs import TextEncoder, encoded, split_pattern, vocabulary_path
from tellstone.llm import registry
from tellstone.llm.mixing import largest_total, mixed, reached_shares, route
from tellstone.llm.truncation import truncated


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x2000, 0x2100), rng.randrange(0x12000, 0x12400), 32, 0x1C, 0x85]))
    made = ["".join(pick() for _ in range(rng.randrange(60))) for _ in range(1500)]
    return made + ["", "a" * 3000, "ab" * 1500 + " " * 2000 + "x", "𒀭" * 900, "\n" * 700, "<|endoftext|> don't 12345", "".join(rng.choice("abcdefgh") for _ in range(2000))]


def test_encoder(reference):
    texts = odd_texts()
    ids, begins = TextEncoder(vocabulary_path(), split_pattern())(texts)
    assert all(ids[begins[i] : begins[i + 1]].tolist() == reference.encode_ordinary(t) for i, t in enumerate(texts))


def test_encoded_column(spark, reference):
    texts = [*odd_texts()[-7:], None, "same", "same"]
    df = spark.createDataFrame([(i, t, "e", 0) for i, t in enumerate(texts)], "doc_id long, text string, made string, ids int")
    rows = encoded(df).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert rows[0]["made"] == "e" and encoded(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["ids"] for r in rows}
    assert all(reference.decode(back[i]) == t for i, t in enumerate(texts) if t)  # round trip
    lengths = {r["doc_id"]: r["n"] for r in encoded(df, out="n", lengths_only=True).collect()}
    assert lengths == {i: len(v) for i, v in back.items()}


def test_flow():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    plan = route(patterns, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 160)
    got = defaultdict(int)
    for (pattern, source, k), tokens in plan.items():
        assert source in pattern and tokens <= patterns[pattern]
        got[source] += tokens
    assert got == {"a": 80, "b": 80}
    assert sum(t for (p, s, k), t in plan.items() if k == 1) == 140  # nothing is repeated before all else is used
    assert largest_total({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) in (40, 41)


def mix_docs(spark, n=400):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big", "big", "big", "small"]) if i else "tiny", rng.randrange(1, 40), i) for i in range(n)]
    rows += [(1000, None, 9, 1), (1001, "big", 0, 2), (1002, "big", None, 3), (1003, "other", 50, 4)]
    rows += [(2000 + i, "small", 30, 7777) for i in range(50)] + [(3000, "big", 30, 7777)]  # one text, many copies, two sources
    df = spark.createDataFrame([(i, s, t, h, h * 7, "x") for i, s, t, h in rows], "doc_id long, source string, n_tokens int, h1 long, h2 long, owners string")
    return rows, df


TARGETS = [("m", "big", 6.0, 1), ("m", "small", 3.0, 3), ("m", "tiny", 0.0, 9), ("m", "absent", 1.0, 2), ("m", "small", 2.0, 1), ("n", "other", 1.0, 2), (None, "big", 1.0, 1), ("m", "bad", None, None)]


def test_mix(spark):
    rows, df = mix_docs(spark)
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_weight double, max_repeats int")
    chosen = mixed(df, targets).collect()
    source = {i: s for i, s, _, _ in rows}
    got, most = defaultdict(int), {"big": 1, "small": 3, "other": 2}
    for r in chosen:
        assert source[r["doc_id"]] == r["source"] and r["times"] <= most[r["source"]] and r["n_tokens"] > 0
        got[r["mix_name"], r["source"]] += r["n_tokens"] * r["times"]
    assert len({(r["mix_name"], r["doc_id"]) for r in chosen}) == len(chosen)
    total = got["m", "big"] + got["m", "small"]
    assert abs(got["m", "big"] / total - 6 / 9) < 0.03 and got["n", "other"] == 100
    again = mixed(df.repartition(5), targets).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))  # the seed decides
    shares = {(r["mix_name"], r["source"]): r for r in reached_shares(mixed(df, targets), targets.where("mix_name is not null")).collect()}
    assert shares["m", "absent"]["tokens"] == 0 and abs(sum(r["actual_share"] for k, r in shares.items() if k[0] == "m") - 1) < 1e-5
    assert mixed(df.limit(0), targets).count() == 0 and mixed(df, targets.limit(0)).count() == 0
    given = mixed(df, targets, totals={"m": 300}).where("mix_name = 'm'").agg(F.sum(F.col("n_tokens") * F.col("times"))).first()[0]
    assert abs(given - 300) <= 120


def test_mix_uses_copies(spark):
    rows = [(i, "a", 10, 5) for i in range(6)] + [(10 + i, "b", 10, 5 if i < 2 else 100 + i) for i in range(8)] + [(30, "a", 10, 9)]
    docs = spark.createDataFrame([(i, s, n, h, h * 7) for i, s, n, h in rows], "doc_id long, source string, n_tokens int, h1 long, h2 long")
    targets = spark.createDataFrame([("m", "a", 7.0, 2), ("m", "b", 8.0, 2)], "mix_name string, source string, target_weight double, max_repeats int")
    chosen = mixed(docs, targets).collect()  # all documents twice give just these shares
    assert {(r["doc_id"], r["source"], r["times"]) for r in chosen} == {(i, s, 2) for i, s, _, _ in rows}


def test_mix_of_all_there_is(spark, folder):
    rows = [(i, "long", 10, i) for i in range(100)] + [(200, "short", 10, 200)]
    docs = spark.createDataFrame([(i, s, n, h, h * 7) for i, s, n, h in rows], "doc_id long, source string, n_tokens int, h1 long, h2 long")
    targets = spark.createDataFrame([("m", "long", 1.0, 1), ("m", "short", 1.0, 3)], "mix_name string, source string, target_weight double, max_repeats int")
    shares = {r["source"]: r for r in reached_shares(mixed(docs, targets, whole=True), targets).collect()}
    assert shares["short"]["tokens"] == 30 and shares["short"]["most_times"] == 3 and 500 <= shares["long"]["tokens"] <= 510
    assert shares["short"]["actual_share"] < 0.06 < shares["short"]["target_share"] == 0.5
    reached = registry.QUERIES["p9_available_shares"](spark, folder).collect()
    assert any(0 < r["actual_share"] < 0.9 * r["target_share"] for r in reached)


SENTENCES = ["The copyist repeats the name of the ruler.", "A later hand omits the offering list (in line 12).", "Is it certain that the scribe mentions the prayer?", "The envoy describes a small delivery of barley cf. no. 12 of the same lot."]


def complete_texts():
    ends = ["", "\n\n", " ", "\n$ single ruling", "\n— Dasur Diqetaris", "\n# Qazubesh; Kapish", ' "The god confirms the name."', " « Le scribe omet le nom. »", " „Der Schreiber bewahrt den Namen.“", "</p>", "<br/>  ", " 'De schrijver bewaart de naam.'", "<|endoftext|>"]
    rng = random.Random(5)
    return [" ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(1, 6))) + rng.choice(ends) for _ in range(400)] + ["The reverse · Tell Ladul (9.1 × 4.4 cm)"] * 20


def judge(spark, texts):
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None, True) for i, t in enumerate(texts)], "doc_id long, text string, source string, cut boolean")
    return {r["doc_id"]: r for r in truncated(df).collect()}


def test_complete_and_blank_texts(spark):
    texts = [*complete_texts(), None, "", "  \n\t ", "</p>"]
    got = judge(spark, texts)
    assert len(got) == len(texts) and [texts[i] for i, r in got.items() if r["cut"]] == []


def test_cut_texts(spark):
    whole = complete_texts()
    rng = random.Random(6)
    cut = []
    for t in whole[:300]:
        body = t.split("\n")[0].rstrip(" </p>brx |endoftext")
        at = rng.randrange(5, len(body))
        while body[:at].rstrip()[-1] in ".?!)”“»\"'":
            at = rng.randrange(5, len(body))
        cut.append(body[:at] + rng.choice(["", "", "…", "...", " …</p>", " [+56 characters]", " "]))
    cut += ["Text (cf. no.", "1. ṣib₂ we-qu\n2. peg-in", "1'. a-b\n2'.", "He said \"the list.", "Tail of the cu�", "A" * 40_000]
    got = judge(spark, whole + cut)
    missed = [cut[i - len(whole)] for i, r in got.items() if i >= len(whole) and not r["cut"]]
    assert missed == []
    assert got[len(whole) + len(cut) - 4]["cut_in"] == "line"


def test_endings_are_learnt(spark):
    texts = [f"The scribe notes zz. {i} and goes on. He stops here~ Then he rests." for i in range(20)]
    got = judge(spark, [*texts, "A line that ends in zz.", "A line that ends so~", "A line that ends in rests", "A line, that ends.", "A line that ends,"])
    assert [got[20 + i]["evidence"] for i in range(5)] == ["ending", None, "ending", None, "ending"]


def test_without_rules_of_structure(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    by = [{r["doc_id"] for r in truncated(docs, structure).where("cut").collect()} for structure in (True, False)]
    assert len(by[0] & by[1]) >= 0.9 * len(by[0]) and len(by[1] - by[0]) <= 0.1 * len(by[0])
    assert truncated(docs).where("evidence in ('trie', 'ending', 'length')").count() >= 0.6 * len(by[0])


def test_words_of_the_corpus(spark):
    whole = complete_texts()
    got = judge(spark, [*whole, "The copyist repeats the name of the rul", "The copyist repeats the name of the ruler", "The scribe omits it.\n$ single rul", "The scribe omits it.\n$ single"] + ["The scribe omits it.\n$ single ruling"] * 30)
    n = len(whole)
    assert [got[n + i]["cut_in"] for i in range(4)] == ["word", "sentence", "word", "sentence"] and not got[n + 5]["cut"]
    assert truncated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_rare_and_long_words_of_the_corpus(spark):
    long = "ka" * 150
    got = judge(spark, ["A word that stands once is zamirtuku here.", f"A sign row {long} is long.", "The scribe omits it.\n$ single zamirt", f"The scribe omits it.\n$ single {long[:250]}"])
    assert [got[i]["cut_in"] for i in range(4)] == [None, None, "word", "word"]
