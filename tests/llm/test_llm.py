import itertools
import json
import random
import re
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernlab.llm import broken, defects, encode, mixing, neardup, overlap, packing, queries, spam
from quernlab.llm.syntax.check import defect
from quernlab.session import materialise

WORDS = [f"w{i}" for i in range(60)]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


def grams(text):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def similar(a, b, t=0.6):
    return bool(a) and bool(b) and len(a & b) / len(a | b) >= t


def edited(rng, texts, n):
    """Random texts, many of them copies or edits of earlier ones."""
    out = list(texts)
    while len(out) < n:
        words = (rng.choice(out) or "").split() if out and rng.random() < 0.6 else rng.choices(WORDS, k=rng.randint(1, 40))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


# 1


class Known(defects.Endings):
    """Endings that know some sentences."""

    def __init__(self):
        super().__init__()
        self.learn(["The loop runs over the list and keeps the best value so far. It passes the tests quickly. We sort the numbers by size first. That is all it has to do."] * 10)


@pytest.mark.parametrize(
    "instruction,output,kind,found",
    [
        ("Explain it to me please.", None, "prose", ["empty"]),
        ("Explain it to me please.", " \u200b\ufeff\n", "prose", ["empty"]),
        ("Explain it to me please.", "```python\n```", "mixed", ["empty"]),
        ("Explain it to me please.", "<answer></answer>", "prose", ["empty"]),
        ("Explain it to me please.", "N/A", "prose", ["empty"]),
        ("Explain it to me please.", "(empty)", "prose", ["empty"]),
        ("Write it.", "print(answer)", "code", []),
        ("Explain it to me please.", "# Solution\n", "code", ["empty"]),
        ("Explain it to me please.", "&nbsp;", "prose", ["empty"]),
        ("Answer yes or no.", "No", "prose", []),
        ("Give the number.", "-1", "prose", []),
        ("Give the name.", "`find_it`", "prose", []),
        ("What is the running time?", "O(n log n)", "prose", []),
        ("List them all.", "3, 5, 8, 13, ...", "prose", []),
        ("Write a function that adds two numbers a and b.", "WRITE A FUNCTION THAT ADDS TWO NUMBERS A AND B.", "code", ["copied_question"]),
        ("Write a function that adds two numbers a and b.", "Question: Write a function that adds two numbers, a and b?", "prose", ["copied_question"]),
        ("Write a function that adds two numbers a and b.", "Write a function that adds two numbers a and b.\nAnswer: use the plus sign, as it adds whatever both sides are.", "prose", []),
        ("Explain it to me please.", "I'm sorry, but I can't help with that.", "prose", ["refusal"]),
        ("Explain it to me please.", "As a language model I cannot do this. Please ask something else.", "code", ["refusal"]),
        ("Explique-moi cela maintenant.", "Désolé, je ne peux pas répondre à cette question.", "prose", ["refusal"]),
        ("Explain it to me please.", "Извините, я не могу помочь с этим запросом.", "prose", ["refusal", "wrong_language"]),
        ("解释一下这个问题好吗", "抱歉，我无法回答这个请求。", "prose", ["refusal"]),
        ("Explain it to me please.", "Sorry for the long detour: the loop runs over the list and keeps the best value so far.", "prose", []),
        ("Explain it to me please.", "You cannot do this in one pass. We sort the numbers by size first.", "prose", []),
        ("How does the loop in this function work?", "Die Funktion gibt am Ende den kleinsten Wert zurück, wenn der Zähler nicht leer ist.", "prose", ["wrong_language"]),
        ("How does the loop in this function work? Answer in German.", "Die Funktion gibt am Ende den kleinsten Wert zurück, wenn der Zähler nicht leer ist.", "prose", []),
        ("How does the loop in this function work?", "如果为空，解法返回最小的值。", "prose", ["wrong_language"]),
        ("Explain it to me please.", "The loop runs over the list and keeps the", "prose", ["truncated"]),
        ("Explain it to me please.", "It passes the tests quickly. We sort the numbers by size first", "prose", []),
        ("Explain it to me please.", "It passes the tests quickly. We sort the numbers, but", "prose", ["truncated"]),
        ("Explain it to me please.", "We sort:\n\n```python\nx = 1\n", "mixed", ["truncated"]),
        ("Explain it to me please.", "We sort:\n\n```python\nx = 1\n```", "mixed", []),
        ("Write code.", "def f(x):\n    for y in x:\n     ", "code", ["truncated"]),
        ("Write code.", "def f(x):\n    return (x +", "code", ["truncated"]),
        ("Write code.", "def f(x):\n    print \"a\", x\n    return x\n", "code", []),
        ("Write code.", "def f(x):\n    return x\n", "code", []),
        (None, "The loop runs over the list and keeps the best value so far.", "prose", []),
        ("Explain it to me please.", "The loop runs over the list and keeps the best value so far. " * 20_000, "prose", []),
    ],
)
def test_defects(instruction, output, kind, found):
    assert defects.defects_of(instruction, output, kind, Known()) == found


@pytest.mark.parametrize(
    "instruction, answer, wrong",
    [
        ("How does Pasaruso use the loop in this function?", "ru", True),
        ("What is the use of compare_rusozos_path and the rusolel in this function?", "ru", True),
        ("Translated statement. Write what the loop in this function is for.", "ru", True),
        ("How does the loop in this function work? Answer in Russian.", "ru", False),
        ("How does the loop in this function work?用Russian回答", "ru", False),
        ("Responde con textos rusos: what is the use of the loop in this function?", "ru", False),
        ("How does the loop in this function work? Bitte auf Deutsch.", "de", False),
        ("How does the loop in this function work? Give a deutschsprachige answer.", "de", False),
        ("What is the loop in this function for? Ответьте на русском языке.", "ru", False),
        ("What is the loop in this function for? 请用德语回答。", "de", False),
        ("Translate this to the language of the author: the loop is for the list.", "de", False),
        ("Please translate what is written in this function.", "ru", False),
        ("Give a translation of the text in this function into Swedish.", "ru", False),
    ],
)
def test_wanted_languages(instruction, answer, wrong):
    given = {"ru": "Функция возвращает наименьшее значение, если список пуст.", "de": "Die Funktion gibt am Ende den kleinsten Wert zurück, wenn der Zähler nicht leer ist."}
    assert defects.wrong_language(instruction, given[answer]) is wrong


WHY = "The topic touches on matters that people with training should handle, and a wrong word could do harm to someone who relies on it. "


@pytest.mark.parametrize(
    "prose, refused",
    [
        ("I'm sorry, but I can't help with that. " + WHY * 5, True),
        (WHY * 8 + "For these reasons I must decline.", True),
        ("抱歉，我无法回答这个请求。" + "这个话题涉及专业知识，错误的说法可能会伤害相信它的人，请咨询有经验的专家。" * 5, True),
        ("The call prints 'Sorry, I can't help' on failure. " + WHY * 5, False),
        ("Sorry, I cannot give a proof. " + "The loop adds `x` to the sum until 10 items are left. " * 10, False),
        (WHY * 10, False),
    ],
)
def test_long_refusals(prose, refused):
    assert defects.refuses(prose) is refused


def test_defects_in_spark(spark, small):
    df = spark.createDataFrame([(1, "a question here", None, None), (1, "a question here", None, None), (None, "q", None, "prose"), (2, None, "fine, thanks.", "prose")], "idx long, instruction string, output string, kind string")
    assert rows(defects.defects_found(df.withColumn("defect", F.lit(0)))) == [(1, "empty")]
    assert defects.defects_found(df.limit(0)).count() == 0
    found = defects.defects_found(spark.read.parquet(f"{small}/pairs.parquet"))
    assert found.columns == ["idx", "defect"] and found.groupBy("idx").count().where("count > 1").count() == 0


# 2


SOURCES = [
    ("python", "x = 1\n", None), ("python", "def f(:\n", "premature_end"), ("python", "x = [1, 2\ny = 3\n", "premature_end"), ("python", "s = 'a\n", "unterminated_literal"),
    ("python", "x = 1)\n", "unbalanced_delimiter"), ("python", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "merge_conflict"), ("python", '"""\n<<<<<<< HEAD\n=======\n>>>>>>> b\n"""\n', None),
    ("python", "print 'x'\n", "invalid_syntax"), ("python", "x = 1\x00", "invalid_syntax"), ("python", "return 1\n", None),
    ("json", '{"a": [1, 2.5e3, true, null, "\\u00e9"]}', None), ("json", "{'a': 1}", "invalid_syntax"), ("json", '{"a": 1,}', "invalid_syntax"), ("json", '{"a": 1', "premature_end"),
    ("json", "01", "invalid_syntax"), ("json", "NaN", "invalid_syntax"), ("json", '"a\nb"', "unterminated_literal"), ("json", "[1] 2", "invalid_syntax"), ("json", "[" * 100_000 + "]" * 100_000, None), ("json", '"\\ud800"', None), ("json", "\ufeff1", "invalid_syntax"),
    ("java", "class A { int f(int n) { return n; } }", None), ("java", "class A { int f(int n) { return n } }", "invalid_syntax"), ("java", "class A { int f(", "premature_end"), ("java", "int x = 1;", "invalid_syntax"), ("java", "class A { void f() { x + 1; } }", "invalid_syntax"),
    ("java", 'import java.util.*;\n@Deprecated public final class A<T extends Comparable<T>> implements I<T> {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  enum E { X, Y { int g() { return 1; } }; int g() { return 0; } }\n  record P(int a, String... b) { P { assert a > 0 : "x"; } }\n  <U> void f(U u, int... xs) throws Exception { for (var x : xs) { if (x > 1 && x < 3 || !(u instanceof String s)) continue; } int[] a = {1, 2}, b[] = new int[3][]; Runnable r = () -> { }; Function<Integer, Integer> g = (x) -> (int) x + (Integer) 2; g = Math::abs; long y = 1L << 3 >>> 2; y >>= 1; String t = switch (xs.length) { case 0, 1 -> "a"; default -> { yield """\n  text "q" """; } }; try (var in = open()) { } catch (A | B e) { } finally { } lab: do { break lab; } while (true); synchronized (this) { } new A<String>() { }.<Integer>f(null); a[0]++; char c = \'\\u0041\'; }\n}', None),
    ("javascript", "let x = 1\nconst f = async (a, {b = 2, ...c}) => { await a; }\n", None), ("javascript", "return 1", "invalid_syntax"), ("javascript", "let x = `a${b + `c${d}`}`;", None), ("javascript", "x = /[/]\\/(a)/g.test(y) / 2;", None), ("javascript", "import a from 'b'", "invalid_syntax"),
    ("javascript", "function f() { return `a", "unterminated_literal"), ("javascript", "for (const [k, v] of m) { x?.y ?? (z ||= 1); }", None), ("javascript", "class A extends B { #p = 1; static { } get x() { return this.#p; } *g() { yield* h(); } }", None), ("javascript", "a.#b", "invalid_syntax"), ("javascript", "1 = 2", "invalid_syntax"), ("javascript", "const x;", "invalid_syntax"),
    ("javascript", "let a = 1 let b = 2", "invalid_syntax"), ("javascript", "if (a) b; else { c }", None), ("javascript", "({a: 1, b, [c]: 2, d() {}, get e() { return 1 }, ...f})", None), ("javascript", "#include <a>\n", "invalid_syntax"), ("javascript", "x => { }\nlabel: for (;;) { break label }", None),
    ("cpp", "#include <vector>\nint main() { return 0; }\n", None), ("cpp", "#include <vec", "unterminated_literal"), ("cpp", "int main() { return 0 }", "invalid_syntax"), ("cpp", "#if X\nint a;\n", "premature_end"), ("cpp", "import java.util.*;", "invalid_syntax"), ("cpp", "def f(x):\n    return x\n", "invalid_syntax"), ("cpp", "'use strict';\nfunction f(n) { }", "invalid_syntax"), ("cpp", '{"a": 1}', "invalid_syntax"),
    ("cpp", 'template <typename T, int N = 3> class A : public B<T>, private C {\npublic:\n  explicit A(int x = 1) : B<T>(x), y{2} {}\n  ~A() = default;\n  A& operator=(const A&) = delete;\n  bool operator()(int a, int b) const noexcept override { return a < b && b > c || a << 2 > 3; }\n  operator bool() const { return true; }\n  static constexpr unsigned long long z = 1ULL;\n  int w : 3;\nprivate:\n  std::vector<std::pair<int, std::map<int, int>>> v;\n};\nnamespace a::b { using X = std::vector<int>; enum class E : int { P = 1, Q }; }\nint main(int argc, char** argv) {\n  auto f = [&, n = 1](auto x) mutable -> int { return x * n; };\n  for (auto& [k, v] : m) std::cout << k << "a" "b" << v << std::endl;\n  for (int i = 0, j = 1; i < 3; ++i, j--) if (int q = i; q) { } else break;\n  int a[3] = {1, 2, 3}, *p = &a[0]; p->x = static_cast<int>(2.5f); delete[] p; int* r = new int[3]{}; const char* s = R"x(")x";\n  switch (a[0]) { case 1: case \'a\': break; default: ; }\n  try { throw std::runtime_error("x"); } catch (const std::exception& e) { } catch (...) { }\n  std::sort(v.begin(), v.end(), [](int a, int b) { return a > b; }); x = y ? z : (w, 1); std::function<int(int)> g; return (int)sizeof(int) + sizeof a;\n}\n', None),
]


@pytest.mark.parametrize("language,text,kind", SOURCES, ids=range(len(SOURCES)))
def test_syntax(language, text, kind):
    assert defect(text, language) == kind


@pytest.mark.parametrize("language", ["python", "java", "cpp", "javascript", "json", None, "cobol"])
def test_blank_sources(language):
    assert defect(None, language) is defect("", language) is defect(" \n", language) is None


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20), st.integers(0, 400), st.sampled_from('{}[]",:x1 '))
@settings(max_examples=200, deadline=None)
def test_json_like_the_parser(value, at, char):
    text = json.dumps(value)
    assert defect(text, "json") is None
    mangled = text[:at] + char + text[at + 1 :]
    try:
        json.loads(mangled, parse_constant=lambda _: 1 / 0)
        good = True
    except (ValueError, ZeroDivisionError):
        good = False
    assert (defect(mangled, "json") is None) == (good or not mangled.strip())


def node_verdicts(tmp_path, sources):
    (tmp_path / "in.json").write_text(json.dumps(sources))
    script = "const vm=require('vm'),s=JSON.parse(require('fs').readFileSync(process.argv[1]));console.log(JSON.stringify(s.map(x=>{try{new vm.Script(x);return true}catch(e){return false}})))"
    return json.loads(subprocess.run(["node", "-e", script, str(tmp_path / "in.json")], capture_output=True, text=True, check=True).stdout)


def test_javascript_like_an_engine(tmp_path, small):
    import shutil

    import pandas as pd

    if not shutil.which("node"):
        pytest.skip("no engine here")
    codes = pd.read_parquet(f"{small.replace('0.001', '0.01')}/all_code.parquet")
    codes = [c for c in codes[codes.path.str.endswith(".js")].code if c and c.strip()]
    rng = random.Random(1)
    cut = [c[: rng.randrange(1, len(c))] for c in codes for _ in range(3)]
    dropped = ["".join(c[:i] + c[i + 1 :]) for c in codes for i in [rng.randrange(len(c))]]
    sources = [s for s in codes + cut + dropped if s.strip()]
    for source, good in zip(sources, node_verdicts(tmp_path, sources)):
        assert (defect(source, "javascript") is None) == good, source


def test_broken_in_spark(spark):
    code = spark.createDataFrame(
        [("1_0", "x = (", "r", "a_1.py"), ("1_0", "x = (", "r", "a_1.py"), ("2_0", "class A {", None, "a_2.java"), ("3_0", None, "r", "a_3.py"), ("4_0", "x = 1", "r", "a_4.py"), ("5_0", "((", "r", "a_5.txt"), ("6_0", "((", "r", None), (None, "((", "r", "a_7.py")],
        "id string, code string, repo string, path string",
    )
    pairs = spark.createDataFrame([(7, "x = ", "code", "c"), (8, "x = ", "prose", "c"), (9, None, "code", "c")], "idx long, output string, kind string, file_key string")
    assert rows(broken.broken_found(code, pairs)) == [("all_code", "1_0"), ("all_code", "2_0"), ("pairs", "7")]
    assert rows(broken.broken_rates(code)) == sorted([("r", "python", 2, 1, 0.5), (None, "java", 1, 1, 1.0)], key=repr)
    assert broken.broken_found(code.limit(0), pairs.limit(0)).count() == 0 and broken.broken_rates(code.limit(0)).count() == 0


# 3


@given(st.integers(5, 300), st.dictionaries(st.integers(1, 300), st.integers(1, 60), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_packing_covers_exactly(capacity, counts):
    counts = {l: n for l, n in counts.items() if l <= capacity} or {1: 1}
    lengths = np.array(sorted(counts))
    packed = packing.solve(capacity, lengths, np.array([counts[l] for l in lengths]))
    total = {}
    for copies, config in packed:
        assert copies > 0 and sum(l * k for l, k in config.items()) <= capacity
        for l, k in config.items():
            total[l] = total.get(l, 0) + copies * k
    assert total == counts
    size = sum(l * n for l, n in counts.items())
    assert sum(c for c, _ in packed) <= 2 * -(-size // capacity)


def test_knapsack_is_best():
    rng = random.Random(2)
    for _ in range(60):
        lengths, capacity = np.array(sorted(rng.sample(range(1, 20), 4))), rng.randint(19, 40)
        values = np.array([rng.random() for _ in lengths])
        most = [range(capacity // n + 1) for n in lengths]
        best, choice = packing.knapsack(capacity, lengths, values)
        assert abs(best[capacity] - max(sum(k * v for k, v in zip(c, values)) for c in itertools.product(*most) if sum(k * n for k, n in zip(c, lengths)) <= capacity)) < 1e-9
        free, worth = capacity, 0.0
        while choice[free] != -1:
            free, worth = (free - 1, worth) if choice[free] == -2 else (free - int(lengths[choice[free]]), worth + values[choice[free]])
        assert abs(worth - best[capacity]) < 1e-9


def test_subset_sum_is_best():
    rng = random.Random(3)
    for _ in range(60):
        lengths, room = np.array(sorted(rng.sample(range(1, 20), 4))), rng.randint(0, 50)
        left = np.array([rng.randint(0, 3) for _ in lengths])
        found = packing.Sums(60, lengths, left).fill(room)
        sums = {sum(k * n for k, n in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in left])}
        assert all(t <= left[i] for i, t in found.items()) and sum(lengths[i] * t for i, t in found.items()) == max(x for x in sums if x <= room)


def test_rare_lengths_are_in_the_program():
    lengths = np.arange(20, 120)
    solution = packing.fractional(1000, lengths, np.ones(100, np.int64))
    covered = np.zeros(100)
    for config, amount in solution.items():
        for i, t in config:
            covered[i] += t * amount
    assert np.allclose(covered, 1, atol=1e-3) and sum(solution.values()) < 1.01 * lengths.sum() / 1000


CAPS = "cap_id int, unit string, capacity int"


def test_packing_in_spark(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 5)
    data = [(i, "same same same", "x") for i in range(60)] + [(100, "long " * 100, None), (101, None, None), (102, "", "y"), (None, "a", "b"), (103, "\u3000wide\u3000space\u3000", "")]
    df = spark.createDataFrame(data, "idx long, instruction string, output string")
    p = packing.pack(df, spark.createDataFrame([(1, "words", 10), (2, "chars", 64)], CAPS))
    items = p.items.collect()
    text = {i: f"{a or ''} {b or ''}" for i, a, b in data}
    for cap, size in ((1, lambda t: len(t.split())), (2, len)):
        mine = [r for r in items if r["cap_id"] == cap]
        assert {r["idx"] for r in mine} == {i for i in text if i is not None}
        per = {}
        for r in mine:
            per.setdefault(r["idx"], []).append(r)
        for idx, pieces in per.items():
            assert sum(r["length"] for r in pieces) == size(text[idx]) and sorted(r["piece"] for r in pieces) == list(range(pieces[0]["n_pieces"]))
            assert len(pieces) == 1 or size(text[idx]) > {1: 10, 2: 64}[cap]
        spots = {}
        for r in mine:
            spots.setdefault(r["container"], []).append((r["place"], r["start"], r["length"]))
        for c in spots.values():
            c.sort()
            assert [x[0] for x in c] == list(range(len(c))) and all(a[1] + a[2] == b[1] for a, b in zip(c, c[1:])) and c[-1][1] + c[-1][2] <= {1: 10, 2: 64}[cap]
    assert rows(p.items) == rows(packing.pack(df.repartition(5), spark.createDataFrame([(1, "words", 10), (2, "chars", 64)], CAPS)).items)
    assert p.containers().where("free < 0").count() == 0 and p.report().count() == 2
    assert packing.pack(df.limit(0), spark.createDataFrame([(1, "words", 10)], CAPS)).items.count() == 0
    # A capacity of several units a cell.
    monkeypatch.setattr(packing, "GRID", 100)
    wide = packing.pack(df, spark.createDataFrame([(3, "chars", 255)], CAPS))
    spots = {}
    for r in wide.items.collect():
        spots.setdefault(r["container"], []).append((r["place"], r["start"], r["length"]))
    for c in spots.values():
        c.sort()
        assert [x[0] for x in c] == list(range(len(c))) and all(a[1] + a[2] <= b[1] for a, b in zip(c, c[1:])) and c[-1][1] + c[-1][2] <= 255
    assert wide.items.count() == len(data) - 1 + 1 and wide.containers().where("free < 0").count() == 0
    for bad in ((1, "words", 0), (1, "lines", 5), (None, "words", 5)):
        with pytest.raises(ValueError):
            packing.pack(df, spark.createDataFrame([bad], CAPS))


# 4


def test_overlap(spark):
    rng = random.Random(4)
    questions = edited(rng, ["", None, "two words", "same text here for all"], 160)
    pool = [f"assert f({i}) == {i}" for i in range(25)] + ["assert True"]
    data = []
    for i, q in enumerate(questions):
        tests = None if rng.random() < 0.3 else [rng.choice(["", " ", "\n"]).join(t.split(" ")) if rng.random() < 0.3 else t for t in rng.sample(pool, rng.randint(0, 3)) + ["assert True"] * rng.randint(0, 1)] + ([None] if rng.random() < 0.1 else [])
        data.append((i, rng.choice(["train", "train", "valid", "test", None, "other"]), rng.choice(["a", "b", None]), q, tests, i))
    data += data[:20]
    schema = "idx long, split string, source string, question string, test_list array<string>, rep long"
    df = spark.createDataFrame(data, schema).withColumn("loaded_at", F.current_timestamp())
    shingles = {d[0]: grams(d[3]) for d in data}
    tests = {d[0]: {re.sub(r"\s+", "", t) for t in d[4] or () if t is not None} for d in data}
    train, held = [d[0] for d in data if d[1] == "train"], [d[0] for d in data if d[1] in ("valid", "test")]
    expected = set()
    for a in set(train):
        for b in set(held):
            common = len(tests[a] & tests[b])
            if similar(shingles[a], shingles[b]) or (common >= 2 and common / len(tests[a] | tests[b]) >= 0.5):
                expected.add((min(a, b), max(a, b)))
    assert set(rows(overlap.overlap_found(df))) == expected and expected
    report = overlap.overlap_report(df).agg(F.sum("n_pairs"), F.sum("n_rows")).first()
    assert tuple(report) == (len(expected), len(set(held)))
    assert overlap.overlap_found(df.limit(0)).count() == 0


# 5


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_SIZE", 3)
    rng = random.Random(6)
    texts = edited(rng, ["", "one", "a b c", "a b c"], 220)
    data = [(i, None if i % 50 == 7 else t[: len(t) // 2], t[len(t) // 2 :] if i % 31 else None, i) for i, t in enumerate(texts)] + [(None, "a b c", "", 0)]
    df = spark.createDataFrame(data, "idx long, instruction string, output string, rep long")
    sets = {d[0]: grams(f"{d[1] or ''} {d[2] or ''}") for d in data if d[0] is not None}
    for t in (0.6, 0.8):
        expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similar(sets[a], sets[b], t)}
        found = neardup.NearDuplicates(df, similarity=t, bits=17)
        assert set(rows(found.pairs())) == expected and expected
        degree = {}
        for p in expected:
            for x in p:
                degree[x] = degree.get(x, 0) + 1
        groups = found.groups().collect()
        assert {r["idx"]: r["n_links"] for r in groups} == degree
        home = {r["idx"]: r["group_id"] for r in groups}
        assert all(home[a] == home[b] <= a for a, b in expected)
    assert neardup.near_duplicates_found(df.limit(0)).count() == 0


def test_shingles_of_one_set_end_before_the_joins():
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(0, 1 << 47, 2000), np.repeat([5, 6], [400, 2]), [7]])
    reps = rng.integers(-(1 << 62), 1 << 62, len(tokens))
    found = set()
    for bucket in range(3):
        parts = [b.filter(pa.compute.equal(b.column("bucket"), bucket)) for half in (slice(0, None, 2), slice(1, None, 2)) for b in neardup._blocks(tokens[half] << 16 >> 16, reps[half], 3)]
        for batch in neardup._linking(parts):
            found |= set(zip(batch.column("rep").to_pylist(), batch.column("token").to_pylist()))
    assert found == {(int(r), int(t)) for r, t in zip(reps, tokens) if t in (5, 6)}


def test_near_duplicates_by_slices(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 40)
    texts = edited(random.Random(8), ["a b c d"], 60)
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "idx long, instruction string, output string")
    expected = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(grams(texts[a]), grams(texts[b]), 0.6)}
    assert set(rows(neardup.near_duplicates_found(df))) == expected and expected


def test_shuffle_files_end_with_the_write(spark):
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if f.endswith(".data")}
    before = files()
    df = spark.range(10_000).repartition(3, "id")
    back = materialise(df)
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before
    assert back.count() == df.count() == 10_000


# 6


TEXTS = ["plain text, isn't it?", "", None, " \n\t ", "<|endoftext|> ordinary", "приветствие 你好 🙂 e\u0301\u200b", "1234567890 " * 50, "x" * 20_000, "a\r\nb  c\u00a0d", "plain text, isn't it?"]


def test_encode(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0), (None, "x", 0)], "doc_id long, text string, word long")
    expected = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in [*enumerate(TEXTS), (0, TEXTS[0]), (None, "x")]]
    for limit in (10, 1_000_000):
        assert rows(encode.encode_corpus(df, block_chars=limit)) == sorted(expected, key=repr)
    assert rows(encode.corpus_sizes(df)) == sorted(((i, len(x)) for i, x in expected), key=repr)
    assert all(r["same"] for r in encode.roundtrip(df.where("doc_id > 0")).collect())
    assert encode.encode_corpus(df.limit(0)).count() == 0


# 7


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 1000), st.just(0.0) | st.floats(1e-3, 1), st.integers(0, 4)), min_size=1), st.integers(0, 5000))
@settings(max_examples=150, deadline=None)
def test_water_fill(sources, total):
    sizes, weights, caps = ({s: v[k] for s, v in sources.items()} for k in range(3))
    drawn = mixing.water_fill(sizes, weights, caps, total)
    usable = {s for s in sources if sizes[s] * caps[s] > 0 and weights[s] > 0}
    assert all(-1e-6 <= drawn[s] <= sizes[s] * caps[s] + 1e-6 for s in sources) and all(drawn[s] == 0 for s in sources if s not in usable)
    assert sum(drawn.values()) == pytest.approx(min(total, sum(sizes[s] * caps[s] for s in usable)), abs=1e-3)
    free = [s for s in usable if drawn[s] < sizes[s] * caps[s] - 1e-6]
    for a, b in itertools.combinations(free, 2):
        assert drawn[a] * weights[b] == pytest.approx(drawn[b] * weights[a], rel=1e-6, abs=1e-6)
    for s in usable - set(free):  # a clamped source would have got more
        assert all(drawn[s] / weights[s] <= drawn[f] / weights[f] + 1e-6 for f in free)


def test_mixture(spark):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 30))), "abc"[i % 3] if i % 10 else None) for i in range(400)] + [(1000, None, "a"), (1001, "x", "unlisted"), (1002, "w1 w2", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("weight", F.lit(9))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("tiny", 0.1, 4), ("none", 0.0, 1)], "source string, weight double, max_repeats int")
    m = mixing.Mixture(df, targets)
    plan = {r["source"]: r for r in m.plan.collect()}
    drawn = m.draw().collect()
    for s, p in plan.items():
        mine = [r for r in drawn if r["source"] == s]
        size = sum(r["n_tokens"] * r["repeats"] for r in mine)
        largest = max((r["n_tokens"] for r in m.texts.where(F.col("source") == s).collect()), default=0)
        assert p["allotted"] - largest - 1 <= size <= p["allotted"] + 1 and all(1 <= r["repeats"] <= p["max_repeats"] for r in mine)
    assert len({r["doc_id"] for r in drawn}) == len(drawn) and not {1001} & {r["doc_id"] for r in drawn}
    assert rows(m.draw()) == rows(mixing.Mixture(df.repartition(7), targets).draw())
    assert rows(m.draw()) != rows(mixing.Mixture(df, targets, seed=1).draw())
    assert m.shares().agg(F.sum("actual_share")).first()[0] == pytest.approx(1)
    empty = mixing.Mixture(df.limit(0), targets)
    assert empty.draw().count() == 0 and empty.shares().count() == 5
    with pytest.raises(ValueError):
        mixing.Mixture(df, targets.union(targets))


# 8


PROSE = "The first line of input holds the number of trees. Each tree is either tall or short, and you must count the tall ones. If there is none, print zero instead."
SPAM = [
    "\n".join(f"https://www.site{i}.example/page/{i}" for i in range(12)), "\n".join(f"- [cheap {w}](http://a.example/{w})" for w in WORDS[:12]), "cheap course online free cheap " * 30,
    "#python #course #free #learn #best #deal " * 6, "Home | Courses | Python | Free | Deals | Login | Contact | Top | Best | Kit", "Tags: " + ", ".join(f"blue {w}" for w in WORDS[:30]),
    "\n".join(f"blue mug KODA-{i}77 {i}9.99 add to cart" for i in range(12)), "\n".join(["Home", "Courses", "Python free", "Deals", "Login", "Contact", "Top", "Best kit"] * 3), "课程 免费 便宜 免费 课程 便宜 " * 12,
    "Best free python course. Top free python deal. Cheap free python kit. Fast free python exam. Easy free python guide. " * 4, PROSE.split(".")[0] + ".\n" + "\n".join(f"https://www.site{i}.example/page/{i}" for i in range(12)),
]
GOOD = [
    PROSE, PROSE + "\n\nSee also:\nhttps://a.example/x\nhttps://b.example/y", "```python\n" + "x = 1\nx = 1\n" * 20 + "```", "Sample input\n" + "1 2 3 4\n" * 20, "Tree height: how tall a tree is.\nTree age: how old a tree is, in whole years.\nTree kind: the name that people give it.",
    "- I tried the first idea, but it is too slow.\n- The second one passes all the tests.\n- TODO check the third one again.", PROSE.replace(" ", "\t"), PROSE.upper(), "你给出的数组长度不超过一千。请输出其中最大的数字。如果没有，输出零。",
]


@pytest.mark.parametrize("text,spammy", [(t, True) for t in SPAM] + [(t, False) for t in GOOD], ids=range(len(SPAM) + len(GOOD)))
def test_pages(text, spammy):
    symbols, lengths = spam.read_page(text)
    states = spam.Model().label(symbols)
    assert (sum(n for n, s in zip(lengths, states) if s != spam.PROSE) > 0.5 * sum(lengths)) is spammy


def test_labels_are_the_likeliest():
    rng = np.random.default_rng(3)

    def viterbi(model, symbols):
        best, back = model.start + model.show[:, symbols[0]], []
        for symbol in symbols[1:]:
            reach = best[:, None] + model.stay
            back.append(reach.argmax(0))
            best = reach.max(0) + model.show[:, symbol]
        states = [int(best.argmax())]
        for arrow in reversed(back):
            states.append(int(arrow[states[-1]]))
        return states[::-1]

    menus = np.zeros_like(spam._SHOW)
    menus[spam.STATES.index("menu"), spam.SYMBOLS.index("long")] = 800
    models = [spam.Model(), spam.Model(menus), *(spam.Model(800 * rng.dirichlet(np.full(11, 0.3), 5), 800 * rng.dirichlet(np.full(5, 0.3), 5)) for _ in range(50))]
    for model in models:
        for _ in range(20):
            symbols = rng.choice(rng.permutation(11)[: rng.integers(1, 5)], rng.integers(1, 30)).tolist()
            assert model.label(symbols) == viterbi(model, symbols)
    pages = [[spam.SYMBOLS.index("long")] * 30, [spam.SYMBOLS.index("sentence")] * 30]
    assert [set(spam.Model(menus).label(p)) for p in pages] == [{spam.STATES.index("menu")}, {spam.PROSE}]
    assert spam.SYMBOLS.index("sentence") in spam.Model().plain


def test_spam_in_spark(spark):
    data = [(i, t) for i, t in enumerate(SPAM + GOOD)] + [(0, SPAM[0]), (100, None), (101, ""), (102, " \n"), (103, "."), (None, SPAM[0]), (104, PROSE * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("nonprose_share", F.lit(1))
    assert {r["doc_id"] for r in spam.spam_found(df).collect()} == set(range(len(SPAM)))
    assert spam.spam_found(df.limit(0)).count() == 0
    report = spam.spam_report(df.where("doc_id is not null").withColumn("source", F.lit(None).cast("string"))).first()
    assert (report["n_docs"], report["n_spam"]) == (len(SPAM + GOOD) + 5, len(SPAM))


# all


def test_registry(spark, small):
    registered = queries.queries()
    assert {f"p{n}" for n in range(1, 9)} == {re.match(r"p\d+", n)[0] for n in registered}
    columns = {"p1_found": ["idx", "defect"], "p2_found": ["tbl", "file_key"], "p4_found": ["idx_a", "idx_b"], "p5_found": ["idx_a", "idx_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, expected in columns.items():
        assert registered[name](spark, small).columns == expected


def test_nothing_outside_imports_this_package():
    root = Path(queries.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if root / "llm" not in path.parents:
            assert "quernlab.llm" not in path.read_text()
    assert "quernlab.llm" in sys.modules


@pytest.mark.parametrize("blanks", [10, 380, 396, 5000])
def test_blanks_before_a_placeholder_do_not_count(blanks):
    assert defects.is_empty(" " * blanks + "TODO") and defects.is_empty("\n" * blanks + "```\n```") and not defects.is_empty(" " * blanks + "The sum is 3.")


@pytest.mark.parametrize("times", [1, 2, 3, 5, 40])
def test_copies_may_be_repeated(times):
    asked = "Write a function that adds two numbers a and b."
    assert defects.copies_instruction(asked, " ".join([asked] * times))
    assert defects.copies_instruction("Say hello", "\n".join(["Say hello"] * times)) and not defects.copies_instruction("Say hello", "hello")
    assert not defects.copies_instruction(asked, "def add(a, b):\n    return a + b\n" * times)


@pytest.mark.parametrize("text", [
    "Niestety nie mogę pomóc w tej sprawie.", "Üzgünüm, bu isteğe yardım edemem.", "죄송하지만 그 요청에는 도움을 드릴 수 없습니다.", "Het spijt me, maar ik kan je daar niet mee helpen.", "Tyvärr kan jag inte hjälpa till med det.", "Maaf, saya tidak bisa membantu.",
    "Xin lỗi, tôi không thể trả lời câu này.", "На жаль, я не можу відповісти.", "عذرا، لا أستطيع المساعدة في ذلك.", "क्षमा करें, मैं इसमें मदद नहीं कर सकता।", "I won't discuss that.", "My guidelines do not let me write `f`.", "No puedo ayudar con eso.", "I won't sort anything for Ada or her graph.", "Ich muss das leider ablehnen.", "我不能提供这个答案。",
])
def test_refusals_in_many_languages(text):
    assert defects.refuses(text)


@pytest.mark.parametrize("text", ["The call prints 'Sorry, I cannot help' on failure. The rest works the same way.", "Sorry for the long detour: the loop has to mark the list first.", "You cannot do this in one pass, so build a set instead.", "I can't see a faster way than this one. Sort the list first."])
def test_answers_that_only_mention_a_refusal(text):
    assert not defects.refuses(text)


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from quernlab.llm.arrow import sliced

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1_000_000] * 30 + ["y"] * 5000)], names=["text"])
    parts = list(sliced([batch]))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist() and max(p.nbytes for p in parts) < 9_000_000 and max(p.num_rows for p in parts) <= 2000


def test_the_least_rows_decide_no_class(spark):
    """An idx read twice with the same stamp and other texts has one text in every step."""
    schema = "idx long, split string, source string, question string, test_list array<string>, loaded_at timestamp"
    data = [(1, "train", "a", "one two three four five", None, None), (1, "train", "a", "six seven eight nine ten", None, None), (2, "test", "a", "one two three four five", None, None), (3, "test", "a", "six seven eight nine ten", None, None)]
    assert overlap.overlap_found(spark.createDataFrame(data, schema)).count() == 1


def test_report_counts_the_pairs(spark, small):
    samples = spark.read.parquet(f"{small}/../sf0.01/samples.parquet")
    report = overlap.overlap_report(samples).agg(F.sum("n_pairs")).first()[0]
    assert report == overlap.cross_split_pairs(samples).count()
