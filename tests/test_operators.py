import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernlab.functions.scan import scan_code
from quernlab.operators import dedup, evaluate, findings, generate, ranking, selection, split
from quernlab.operators.components import connected_components
from quernlab.plans import techniques
from quernlab.sources import reading, writing


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


# ranks and selection


def scored(spark, n=100, score=lambda i: float(i % 7)):
    return spark.createDataFrame([(i, score(i)) for i in range(n)], "idx long, score double")


def test_filter_pairs(spark):
    df = scored(spark)
    assert selection.filter_pairs(df, ratio=0.29).count() == 28
    assert selection.filter_pairs(df, threshold=6.0).count() == 14
    assert [r["idx"] for r in selection.filter_pairs(df, topk=3).collect()] == [6, 13, 20]
    for wrong in ({}, {"topk": 1, "ratio": 0.5}):
        with pytest.raises(ValueError):
            selection.filter_pairs(df, **wrong)
    assert selection.filter_pairs(df.limit(0), ratio=0.2).count() == 0
    assert selection.filter_pairs(scored(spark, 1), ratio=0.2).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, 0.0)], "idx long, score double")
    assert [r["idx"] for r in selection.filter_pairs(nulls, topk=2).collect()] == [2, 1]


def test_rank_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 10)
    df = scored(spark, 95)
    expected = {i: r for r, (i, _) in enumerate(sorted(((i, i % 7) for i in range(95)), key=lambda x: (-x[1], x[0])), 1)}
    assert {r["idx"]: r["rank"] for r in selection.rank_pairs(df).collect()} == expected


def test_select(spark):
    df = spark.createDataFrame([(i, "a b c", "a b" if i % 2 else None, "x") for i in range(10)], "idx long, question string, solutions string, score string")
    assert selection.select(df.drop("score")).columns == ["question", "solutions", "score"]
    assert selection.select(df.drop("score"), keep_columns=True, topk=5, ratio=None).select(F.min("score")).first()[0] == 1.0
    states, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert selection.max_pool(states, mask).tolist() == [[4, 5, 6, 7]] and selection.mean_pool(states, mask).tolist() == [[2, 3, 4, 5]]


def test_scorers_state_their_limits(spark):
    question, answer = " ".join(f"w{i}" for i in range(600)), " ".join(f"w{i}" for i in range(599, -1, -1))
    df = spark.createDataFrame([(1, question, answer, 1.0), (2, "w0", answer, 1 / 600)], "idx long, question string, solutions string, expected double")
    assert selection.select(df, ratio=None, topk=2, keep_columns=True).where("abs(score - expected) > 1e-12").count() == 0

    def counter():
        return lambda asked, given: [float(len(g.split())) for g in given]

    score = lambda **x: [r["score"] for r in selection.score_pairs(df, **x).orderBy("idx").collect()]
    assert score(load=counter) == [512.0, 512.0] and score(load=counter, max_length=7) == [7.0, 7.0]
    assert score(load=selection.overlap_scorer, max_length=1) == [0.0, 0.0]


# splits and joins


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "idx").withColumn("part", F.lit("clash"))
    for parts, sizes in ((split.split_train_valid_test(df), {"train": 82, "valid": 11, "test": 10}), (split.split_train_eval(df), {"train": 102, "eval": 1})):
        assert dict(rows(parts.groupBy("part").count())) == sizes and parts.select("idx").distinct().count() == 103
    assert rows(split.split_train_eval(df)) == rows(split.split_train_eval(df.repartition(7)))
    assert split.split_train_valid_test(df.limit(0)).count() == 0
    assert [r["idx"] for r in split.shuffled(df, "idx").collect()] == [r["idx"] for r in split.shuffled(df.repartition(5), "idx").collect()] != list(range(103))


def test_quality(spark):
    a = spark.createDataFrame([(1, 4.0), (2, 6.0)], "idx long, score double")
    b = spark.createDataFrame([(1, 2.0), (3, 1.0)], "idx long, score double")
    assert rows(split.quality(a, b, strict=False)) == [(1, 4.0, 2.0, 3.0)]
    with pytest.raises(Exception, match="no second score"):
        split.quality(a, b).collect()


def test_pair_filter(spark):
    data = [(1, "a", "b", 5.0, 6.0), (2, "a", "a", 5.0, 6.0), (3, "a", "b", 1.0, 9.0), (4, None, "b", 4.0, None), (5, None, None, 5.0, 5.0), (6, "a", "b", 3.0, 5.0)]
    df = spark.createDataFrame(data, "idx long, answer1 string, answer2 string, score1 double, score2 double")
    kept = {m: [r[0] for r in rows(split.pair_filter(df, m, 3.0, 7.0), "idx")] for m in split.MODES}
    assert kept == {"abs": [1], "abs_pos": [1], "diff": [1, 6], "abs_diff": [1], "none": [1, 3, 4, 6]}
    with pytest.raises(ValueError):
        split.pair_filter(df, "other", 0, 1)


def test_aligned(spark):
    t = lambda *r: spark.createDataFrame(list(r), "idx long, instruction string, output string")
    a = t((1, "q", "x"), (2, None, "y"))
    assert len(rows(split.aligned(a, a, a))) == 2
    with pytest.raises(Exception, match="instructions differ"):
        split.aligned(a, t((1, "other", "x")), a).collect()


def test_training_rows(spark):
    df = spark.createDataFrame([(0, "ab", "c"), (1, "a", None), (2, None, "xyz")], "idx long, prompt string, answer string")
    rows_ = split.masked(split.tokenised(df, lambda: lambda texts: [list(t.encode()) for t in texts], max_length=3))
    assert {r["idx"]: (r["input_ids"], r["labels"]) for r in rows_.collect()} == {0: ([97, 98, 99], [-100, -100, 99]), 1: ([97], [-100]), 2: ([120, 121, 122], [120, 121, 122])}
    batch = {r["idx"]: r for r in split.padded(rows_, 2, pad=0).collect()}
    assert batch[1]["input_ids"] == [97, 0, 0] and batch[1]["labels"] == [-100] * 3 and batch[1]["attention_mask"] == [1, 0, 0] and batch[2]["attention_mask"] == [1, 1, 1]
    turns = spark.createDataFrame([(1, [("human", [1, 2]), ("gpt", [3])], 3), (2, [("gpt", [3])], 2)], "idx long, turns array<struct<who:string,ids:array<int>>>, n_tokens int")
    assert {r["idx"]: r["labels"] for r in split.chat_labels(turns).collect()} == {1: [-100, -100, 3], 2: [-100]}


# findings


def test_training_rows_are_whole(spark):
    df = spark.createDataFrame([(1, "p" * 1000, "a" * 1000)], "idx long, prompt string, answer string")
    got = split.tokenised(df, lambda: lambda texts: [list(t.encode()) for t in texts]).first()
    assert (len(got["prompt_ids"]), got["answer_ids"]) == (1000, [ord("a")] * 1000)


def finding_table(spark):
    data = [
        ("f_1.py", "a.b.x", 1, "ERROR", "security", ["CWE-1", "CWE-2"], None, "HIGH", None),
        ("f_1.py", "a.b.x", 1, "ERROR", "security", ["CWE-1"], ["A1"], None, "LOW"),
        ("f_2.py", "y", 2, "INFO", None, ["CWE-2"], None, None, None),
        ("f_3.py", "a.z", 3, "WARNING", "style", None, None, None, None),
        ("f_3.py", "a.w", 3, "OTHER", "style", [], None, None, None),
        (None, "a.w", 3, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(data, "path string, check_id string, line int, severity string, category string, cwe array<string>, owasp array<string>, impact string, confidence string")


def test_findings(spark):
    f = finding_table(spark)
    errors = spark.createDataFrame([("f_2.py",), ("f_4.py",), (None,), ("f_2.py",)], "path string")
    files = spark.createDataFrame([(f"f_{i}.py",) for i in range(1, 6)], "path string")
    assert dict(rows(findings.split_three_way(files, f, errors))) == {"f_1.py": "defective", "f_2.py": "syntax_error", "f_3.py": "defective", "f_4.py": "syntax_error", "f_5.py": "clean"}
    assert rows(findings.defective_files(f, errors)) == [("f_1.py",), ("f_3.py",)]
    assert findings.findings_without_errors(f, errors).count() == 5
    assert dict(rows(findings.category_counts(f))) == {"security": 3, "style": 2}
    matrix = {(r[0], r[1]): (r[2], r[3]) for r in rows(findings.severity_by_category(f))}
    assert len(matrix) == 8 and matrix["ERROR", "security"] == (2, 100.0) and matrix["INFO", "style"] == (0, 0.0)
    assert rows(findings.top_issues(f, 1)) == [("style", 1, "w", 1, 50.0), ("style", 2, "OTHERS", 1, 50.0)]
    assert dict(rows(findings.counts_of_labels(f, "cwe"))) == {"CWE-1": 2, "CWE-2": 2}
    assert rows(findings.cwe_by_severity(f)) == [("CWE-1", 0, 0, 2, 2), ("CWE-2", 1, 0, 1, 2)]
    assert rows(findings.top_cwe(f, 1)) == [(1, "CWE-1", 2, 50.0), (2, "OTHERS", 2, 50.0)]
    assert rows(findings.rates(files, f, errors)) == [(5, 6, 40.0, 40.0, 120.0, 20.0)]
    assert rows(findings.line_lists(spark.createDataFrame([(3,), (None,), (1,), (3,)], "n long"))) == [(0,), (2,)]
    none = f.limit(0)
    assert rows(findings.rates(files.limit(0), none, errors.limit(0))) == [(0, 0, 0.0, 0.0, 0.0, 0.0)]
    for operator in (findings.severity_counts, findings.severity_by_category, findings.top_issues, findings.top_issues_by_severity, findings.cwe_by_severity, findings.top_cwe, findings.domains):
        assert operator(none).count() == 0


def test_scan(spark):
    data = [(1, "eval(x)\ntry:\n    pass\nexcept:\n    pass\n"), (2, "def ("), (3, None), (4, " "), (5, "x = 1\n")]
    out = scan_code(spark.createDataFrame(data, "path long, code string")).collect()
    assert [r["path"] for r in out if r["is_error"]] == [2]
    assert {r["check_id"].split(".")[-1] for r in out if r["path"] == 1} == {"dynamic-eval", "bare-except", "silent-except"} and not [r for r in out if r["path"] in (3, 4, 5)]


# duplicates


SENTENCES = ["the quick brown fox jumps over the dog", "the quick brown fox jumps over the cat", "a completely other sentence is here now", "a completely other sentence is here now", "THE quick brown fox jumps over the dog", "", None, "two words"]


def brute(texts, n, t):
    sets = {i: {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} for i, x in texts if x is not None for w in [x.lower().split()]}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = list(enumerate(SENTENCES))
    for i in range(len(texts), 150):
        base = (rng.choice(texts)[1] or "").split() if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 20))
        for _ in range(rng.randint(0, 2)):
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
        texts.append((i, " ".join(base)))
    df = spark.createDataFrame([(*t, "extra") for t in texts], "id long, text string, rep string")
    for n, t in ((2, 0.5), (3, 0.7), (1, 1.0)):
        found = dedup.SimilarSets(df, "id", "text", n, t)
        members = found.members.collect()
        same = {}
        for m in members:
            same.setdefault(m["rep"], []).append(m["id"])
        pairs = {tuple(sorted(p)) for g in same.values() for p in itertools.combinations(g, 2)}
        pairs |= {tuple(sorted((x, y))) for r in found.links.collect() for x in same[r["a"]] for y in same[r["b"]]}
        expected = brute(texts, n, t)
        assert pairs == expected
        degree = {}
        for a, b in expected:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        clusters = found.clusters()
        assert {r["id"]: r["n_links"] for r in clusters.collect()} == degree
        kept = {r["id"] for r in dedup.distinct_rows(df, "id", clusters).collect()}
        assert kept == {i for i, _ in texts} - {r["id"] for r in clusters.collect() if r["id"] != r["cluster_id"]}
    assert dedup.near_dup_clusters(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_similarities_in_blocks(spark, monkeypatch, repeated):
    monkeypatch.setattr(dedup, "ASKED", 30)
    rng = random.Random(4)
    data = [(i, " ".join(rng.choices("abcd", k=rng.randrange(12)))) for i in range(40)] + [(3, "a b c d a b"), (None, "a b c")][0 if repeated else 1 :]
    sets = {}
    for i, text in data:
        words = text.split()
        sets.setdefault(i, set()).update(zip(words, words[1:], words[2:]))
    expected = {(q, i): len(sets[q] & sets[i]) / len(sets[q] | sets[i]) for q in range(0, 40, 4) for i in range(40) if i != q and sets[q] & sets[i]}
    df = spark.createDataFrame(data, "i long, t string")
    found = dedup.similarities(df, "i", "t", F.col("i") % 4 == 0)
    assert {(r["query_id"], r["id"]): r["similarity"] for r in found.collect()} == expected and found.count() == len(expected)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()
    assert dedup.similarities(df.limit(0), "i", "t", F.col("i") % 4 == 0).count() == 0


def test_minhash_finds_most(spark, small):
    df = spark.read.parquet(f"{small}/pairs.parquet").select("idx", F.concat_ws(" ", "instruction", "output").alias("text"))
    exact = rows(dedup.SimilarSets(df, "idx", "text", 3, 0.5).links)
    found = rows(dedup.verified(dedup.minhash_candidates(dedup.minhash_signatures(df, "idx", "text")), df, "idx", "text"))
    assert set(found) <= set(exact) or len(set(found) & set(exact)) >= 0.9 * len(exact)
    assert len({x[:2] for x in found} & {x[:2] for x in exact}) >= 0.9 * len(exact)


def test_minhash_keeps_rows_of_equal_keys(spark):
    # 1 and 2 are copies, 3 has another set with all the same keys, 4 shares a single key with both sets.
    signatures = spark.createDataFrame([(1, b"x", [5, 6]), (2, b"x", [5, 6]), (3, b"y", [5, 6]), (4, b"z", [5, 7])], "id long, digest binary, bands array<long>")
    assert rows(dedup.minhash_members(signatures)) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert rows(dedup.minhash_candidates(signatures)) == [(1, 2), (1, 3), (1, 4), (3, 4)]
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    signatures = dedup.minhash_signatures(df, "idx", "text", num_perm=2, num_bands=2)
    assert len({tuple(r["bands"]) for r in signatures.collect()}) == 1
    found = rows(dedup.verified(dedup.minhash_candidates(signatures), df, "idx", "text"))
    assert [(a, b, round(s, 4)) for a, b, s in found] == [(0, 1, 1.0), (0, 2, 0.9997)]


def test_greedy_and_exact(spark):
    assert dedup.greedy_clusters([(3, 4), (1, 2), (2, 3)]) == [[1, 2, 3], [3, 4]] or dedup.greedy_clusters([(3, 4), (1, 2), (2, 3)]) == [[1, 2, 3, 4]]
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id long, text string")
    assert rows(dedup.exact_duplicates(df, "id", "text")) == [(1, 2)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# metrics


def test_metrics(spark):
    items = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "idx long")
    runs = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0), (2, 0, None), (9, 0, 1.0)], "idx long, j int, ratio double")
    assert rows(evaluate.pass_at_k(items, runs, 1)) == [(3, 0.0)] and rows(evaluate.pass_at_k(items, runs, 2)) == [(3, pytest.approx(1 / 3))]
    assert rows(evaluate.average_pass_ratio(items, runs)) == [(3, pytest.approx(1 / 3))]
    assert rows(evaluate.pass_at_k(items.limit(0), runs)) == [(0, 0.0)]
    ids = spark.createDataFrame([("3_12",), ("x",), (None,), ("1_2_3",)], "id string")
    assert rows(evaluate.split_generation_id(ids)) == sorted([("3_12", 3, 12), ("x", None, None), (None, None, None), ("1_2_3", None, None)], key=repr)
    scores = spark.createDataFrame([("d", "c-200", 0.5), ("d", "c-30", 0.5), ("d", "c-1", None), ("e", "c-1", 0.1)], "dataset string, checkpoint string, pass1 double")
    assert rows(evaluate.best_checkpoint(scores, ["dataset"])) == [("d", "c-30", 0.5), ("e", "c-1", 0.1)]
    attempts = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", True), (2, 0, "a", None), (2, 1, None, False)], "idx long, attempt int, code string, passed boolean")
    done = evaluate.first_passing(attempts)
    assert rows(done) == [(1, 2, True, "b"), (2, 2, False, None)]
    assert rows(evaluate.failure_ratio(done)) == [(2, 1, 0.5)]


# generation


def test_generation(spark):
    pairs = spark.createDataFrame([(1, "ask", "old"), (2, "go down", "old"), (3, None, None)], "idx long, instruction string, output string")

    def load():
        def client(prompt):
            if "go down" in prompt:
                raise RuntimeError("down")
            return "Final Score: 6"

        return client

    judged = {r["idx"]: (r["score"], r["content"]) for r in generate.judge(pairs, load, "correctness").collect()}
    assert judged == {1: (6.0, "Final Score: 6"), 2: (None, "Error: down"), 3: (6.0, "Final Score: 6")}
    assert {r["idx"]: r["output"] for r in generate.rewrite_style(pairs, load).collect()} == {1: "Final Score: 6", 2: "old", 3: "Final Score: 6"}
    replies = generate.complete(pairs.select("idx", F.col("instruction").alias("prompt")), load, n=2)
    assert rows(generate.generation_ids(replies), "id")[0] == ("1_0",) and replies.count() == 6
    assert [r["idx"] for r in generate.sample_rows(pairs, 2).collect()] == [r["idx"] for r in generate.sample_rows(pairs.repartition(3), 2).collect()]


SAMPLES = "idx long, dataset string, question string, solutions string, input_output string, test_list array<string>"


def test_techniques(spark):
    good = "def add(a, b):\n    c = a\n    c += b\n    return c\n"
    data = [(1, "mbpp", "add", good, None, ["assert add(1, 2) == 3"]), (1, "mbpp", "add", good, None, ["assert add(1, 2) == 3"]), (2, "mbpp", "bad", "def (", None, ["assert True"]), (3, "apps", "none", None, None, None)]
    samples = spark.createDataFrame(data, SAMPLES)
    grown = techniques.augmentation(samples)
    kept = {r["transform"] for r in grown.collect() if r["idx"] == 1}
    assert {None, "add_assign_to_equal_assign"} <= kept and "rearrange_code" not in kept
    assert grown.where("transform is null").count() == 4 and grown.where("idx = 2").count() == 1
    assert dict(rows(techniques.cleaning(samples).groupBy("bucket").count())) == {"clean": 3, "syntax_error": 1}
    chained = techniques.chain(samples, "Refactoring", "sel", sel={"ratio": 1.0})
    assert set(chained.columns) == set(samples.columns) and chained.count() == 4

    def load():
        tries = iter(["```python\ndef add(a, b): return 0\n```", "```python\ndef add(a, b): return a + b\n```"])
        return lambda prompt: next(tries)

    made = techniques.synthesis(samples.where("idx = 1").limit(1), load).first()
    assert made["passed"] and made["solutions"] == "def add(a, b): return a + b"
    generations = spark.createDataFrame([("1_0", "def add(a, b): return 0"), ("1_1", good), ("1_1", good), ("bad", "x")], "id string, code string")
    result = techniques.evaluation(samples.where("idx = 1"), generations, k=2).first()
    assert (result["test_pass1"], result["avg_pass_ratio"]) == (0.0, 1.0) and 0 < result["avg_mi_score"] <= 100
    for wrong in ("x", None):
        with pytest.raises(ValueError):
            techniques.normalize_technique(wrong)


# files


def test_files(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"idx": 1, "question": "q"}\n\n{"idx": 2, "solutions": null}\n')
    df = reading.read_jsonl(spark, str(path), reading.SAMPLE_SCHEMA)
    assert df.count() == 2
    writing.write_jsonl(df, str(tmp_path / "out"))
    assert '"source":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    raw = reading.read_raw_lines(spark, str(path), "idx long", strict=False)
    assert [r["parsed"]["idx"] for r in raw.collect()] == [1, 2]
    with pytest.raises(Exception):
        reading.read_raw_lines(spark, str(path), "idx long").collect()
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert reading.read_json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    (tmp_path / "m.json").write_text('{"x": 1.5, "y": 2}')
    assert rows(reading.read_score_map(spark, str(tmp_path / "m.json"))) == [("x", 1.5), ("y", 2.0)]
    report = '{"errors": [{"path": "e_1.py"}], "results": [{"path": "f_1.py", "check_id": "a.b", "extra": {"severity": "INFO", "metadata": {"cwe": %s}}}], "paths": {"scanned": ["f_1.py"]}}'
    for i, cwe in enumerate(('"CWE-1"', '["CWE-1", "CWE-2"]', "null")):
        (tmp_path / f"r_{i}.json").write_text(report % cwe)
    parts = reading.read_reports(spark, str(tmp_path / "r_*.json"))
    assert sorted(map(str, (r["cwe"] for r in parts["findings"].collect()))) == ["None", "['CWE-1', 'CWE-2']", "['CWE-1']"]
    assert parts["errors"].count() == parts["scanned"].count() == 3
    for name in ("checkpoint-200", "checkpoint-30", "other"):
        (tmp_path / "ck" / name).mkdir(parents=True)
    assert [r["step"] for r in reading.list_checkpoints(spark, str(tmp_path / "ck")).collect()] == [30, 200]
    assert writing.export_json_array(df.select("idx"), str(tmp_path / "x.json")) == 2
    keyed = spark.createDataFrame([(1, "k", 1.0), (2, "k", 2.0)], "idx long, key string, score double")
    assert writing.export_score_map(keyed, str(tmp_path / "s.json")) == 1 and (tmp_path / "s.json").read_text() == '{"k": 2.0}'
    seen, counters = writing.run_report(df, "report", {"with_question": F.col("question").isNotNull()})
    seen.collect()
    assert counters.get == {"rows": 2, "with_question": 1}
    both = spark.createDataFrame([(1, {"output": "a"}, None), (2, None, "b")], "idx long, o struct<output:string>, value string")
    assert rows(reading.code_of_items(both.select("idx", "o.output", "value"))) == [(1, "a"), (2, "b")]


def test_stream(spark, tmp_path):
    from quernlab.streaming.jsonl import apply_stream, read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"idx": 1, "solutions": "x = \\"a\\""}\n')
    apply_stream(read_stream(spark, str(tmp_path / "in")), techniques.refactoring, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first()["solutions"] == "x = 'a'\n"


# scanner


@pytest.mark.parametrize("source, check", [
    ("import requests\nrequests.get(u, verify=False)\n", "security.unverified-tls"), ("c.execute(f'select {x}')\n", "security.built-query"), ("c.execute('select %s' % x)\n", "security.built-query"), ("password = 'hunter22'\n", "security.secret-in-source"),
    ("app.run(debug=True)\n", "security.debug-server"), ("os.chmod(p, 0o777)\n", "security.wide-rights"), ("tempfile.mktemp()\n", "security.guessable-file"), ("a = eval(x)\n", "security.dynamic-eval"), ("subprocess.run(c, shell=True)\n", "security.shell-true"),
    ("assert (x, 'm')\n", "correctness.assert-tuple"), ("d = {'a': 1, 'a': 2}\n", "correctness.doubled-key"), ("raise 'x'\n", "correctness.raise-unfit"), ("a == b\n", "correctness.useless-compare"), ("def f():\n    return 1\n    x = 2\n", "correctness.code-after-end"), ("x = x\n", "correctness.self-assignment"),
    ("for a in b:\n    b.remove(a)\n", "correctness.changed-while-read"), ("try:\n    f()\nfinally:\n    return\n", "correctness.return-in-finally"), ("if x == None:\n    f()\n", "best-practice.compare-none"), ("from a import *\n", "best-practice.star-import"), ("breakpoint()\n", "best-practice.leftover-breakpoint"),
    ("for i in range(len(a)):\n    f(i)\n", "maintainability.index-loop"), ("m = sorted(a)[0]\n", "performance.sorted-first"), ("s = sum([x for x in y])\n", "performance.list-of-comprehension"), ("f = open(p)\n", "best-practice.open-unclosed"),
])
def test_rules(source, check):
    from quernlab.functions.scan import findings_of

    assert f"quern.{check}" in {rule.check_id for rule, _ in findings_of(source)}
    assert not list(findings_of("import math\n\n\ndef area(radius):\n    return math.pi * radius**2\n"))


def test_long_sources_are_scanned(spark):
    source = "x = 1\n" * 200_000 + "y = eval(x)\n"
    found = scan_code(spark.createDataFrame([("a", source)], "path string, code string")).collect()
    assert [(r["is_error"], r["check_id"], r["line"]) for r in found] == [(False, "quern.security.dynamic-eval", 200_001)]


# models


def test_encoder_scorer(spark):
    def load():
        def encode(instructions, answers):
            sizes = [len(a.split()) for a in answers]
            states = np.array([[[float(len(i)), 1.0]] * max([1, *sizes]) for i in instructions])
            return states, np.array([[k < n for k in range(max([1, *sizes]))] for n in sizes])

        return encode

    df = spark.createDataFrame([(1, "abc", "x y"), (2, "abcd", "x"), (3, "a", None)], "idx long, question string, solutions string")
    scored = selection.score_pairs(df, selection.encoder_scorer(load, np.array([2.0, 1.0]), 0.5))
    assert rows(scored, "idx", "score") == [(1, 7.5), (2, 9.5), (3, None)]


def test_style_needs_rows_told_apart(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "idx long, instruction string, output string")
    with pytest.raises(ValueError):
        generate.rewrite_style(df, lambda: lambda prompt: "x")
    assert rows(generate.rewrite_style(df.limit(1), lambda: lambda prompt: "x"), "idx", "output") == [(1, "x")]


def test_words_and_marks(spark):
    df = spark.createDataFrame([(1, "Sum, then stop."), (2, "sum , then stop ."), (3, "other words stand here")], "id long, text string")
    assert rows(dedup.SimilarSets(df, "id", "text", 2, 0.9, dedup.PUNCTUATED).members) == [(1, 1), (2, 1), (3, 3)]
    assert rows(dedup.SimilarSets(df, "id", "text", 2, 0.9).members) == [(1, 1), (2, 2), (3, 3)]


def test_evaluation_counts_an_id_once(spark):
    items = spark.createDataFrame([(1, "mbpp", None, ["assert f(1) == 1"])], "idx long, dataset string, input_output string, test_list array<string>")
    once = spark.createDataFrame([("1_0", "def f(x):\n    return x\n"), ("1_1", "import os, sys\ndef f(x):\n    return 2\n")], "id string, code string")
    again = once.unionByName(once.where("id = '1_1'"))
    assert rows(techniques.evaluation(items, again, 2)) == rows(techniques.evaluation(items, once, 2)) and techniques.evaluation(items, once, 2).first()["test_pass1"] == 1.0
