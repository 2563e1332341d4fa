import random
from collections import Counter

from fixtures_llm import WORD

from oracle import connect, difference
from revisit.llm import line_dedup
from revisit.llm.copies import marks, split_by_marks
from revisit.llm.line_dedup import repeated_lines, without_repeated_lines
from revisit.llm.queries import LLM_ORACLES, LLM_QUERIES


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(pairs, min_words):
    """(key, line) -> (kept key, kept line, exact), by comparing all lines with all earlier ones."""
    lines = []
    for k, t in pairs:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            words = tuple(WORD.findall(line.lower()))
            if len(words) == 1 and len(words[0]) >= 20:
                words = ("", "", *words[0])
            if words:
                lines.append(((k is not None, k or 0, i), words))
    lines.sort()
    first = {}
    for place, words in lines:
        first.setdefault(words, place)
    made = {}
    for place, words in lines:
        near = [
            p for w, p in first.items()
            if min(len(w), len(words)) >= min_words and w != words and p < first[words] and one_edit(w, words)
        ]
        if near:
            made[place] = (*min(near), False)
        elif place != first[words]:
            made[place] = (*first[words], True)
    return {(k if there else None, i): (a if b else None, j, e) for (there, k, i), (b, a, j, e) in made.items()}


def found(frame, min_words):
    rows = repeated_lines(frame, min_words=min_words).collect()
    return Counter((r.doc_id, r.line, r.kept_doc_id, r.kept_line, r.exact) for r in rows)


def test_query_equals_sql(spark, tiny):
    name = "op4_line_dedup"
    assert difference(LLM_QUERIES[name](spark, tiny), connect(tiny), LLM_ORACLES[name]) is None


def test_random_lines(docs_of):
    random.seed(3)
    base = [[random.choice("abcdefgh") for _ in range(random.choice([2, 3, 4, 5, 6, 9]))] for _ in range(12)]
    pairs = []
    for k in range(60):
        lines = []
        for _ in range(random.randint(0, 6)):
            words = list(random.choice(base))
            for _ in range(random.randint(0, 2)):
                at = random.randrange(len(words) + 1)
                words[at : at + random.randint(0, 1)] = random.choice([[], ["X"], ["y"]])
            lines.append("  ".join(words).upper() if random.random() < 0.2 else " ".join(words))
        pairs.append((k, "\n".join(lines)))
    wanted = expected(pairs, 2)
    made = found(docs_of(pairs), 2)
    assert made == Counter((k, i, *v) for (k, i), v in wanted.items())
    assert {e for *_, e in made} == {True, False}


def test_odd_rows_and_new_texts(docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    pairs = [
        (1, "a b c d e\nshort\n\na b c d e"), (2, None), (3, ""), (4, "\n\n"), (5, "x\na b c D e f\nlast"),
        (6, long), (7, long + " end\nkeep me here as well"), (None, "a b c d q"), (8, "short\nshort"),
    ]
    docs = docs_of(pairs)
    assert found(docs, 5) == Counter((k, i, *v) for (k, i), v in expected(pairs, 5).items())
    made = {r.doc_id: r for r in without_repeated_lines(docs).collect()}
    assert made[None].text == "a b c d q" and made[1].text == "short\n" and made[5].text == "x\nlast"
    assert made[7].text == "keep me here as well" and made[7].n_chars == 20
    assert made[2].text is None and made[3].text == "" and made[4].text == "\n\n"
    assert made[8].text == "" and without_repeated_lines(docs).schema.names == docs.schema.names
    assert repeated_lines(docs.limit(0)).count() == without_repeated_lines(docs.limit(0)).count() == 0


def test_lines_without_spaces(docs_of):
    chinese = "这是一个没有空格的长句子它在许多文件中重复出现"
    emoji = "😀😁😂🤣😃😄😅😆😉😊😋😎😍😘😗😙😚🙂🤗🤩"
    pairs = [
        (1, chinese), (2, chinese[:7] + "三" + chinese[8:]), (3, chinese[1:]), (4, chinese), (5, chinese[3:]),
        (6, emoji), (7, emoji[:-1] + "🧐"), (8, " ".join("abcdefghijklmnopqrst")), (9, "abcdefghijklmnopqrst"),
        (10, "short"), (11, "shore"), (12, "Short"), (13, "abcdefghijklmnopqrsu " + chinese),
    ]
    wanted = expected(pairs, 5)
    assert {k for k, _ in wanted} == {2, 3, 4, 7, 12}
    assert found(docs_of(pairs), 5) == Counter((k, i, *v) for (k, i), v in wanted.items())


def test_many_near_lines_are_joined_by_marked_documents(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 3)
    pairs = [(k, f"line of words number {k % 9} here\nalone {k} {k * 7} x{k} y{k}") for k in range(60)] + [(None, None)]
    wanted = expected(pairs, 5)
    assert found(docs_of(pairs), 5) == Counter((k, i, *v) for (k, i), v in wanted.items())


def test_marks_miss_nothing(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    marked = marks(keys.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "k")
    rows = spark.range(5000).selectExpr("id AS doc", "'x' AS mark_bits").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'y'"))
    touched, rest = split_by_marks(rows, "doc", marked)
    assert touched.columns == rest.columns == ["doc", "mark_bits"]
    held = {r.doc for r in touched.collect()}
    assert {None, *range(0, 5000, 7)} <= held and len(held) < 1000
    assert touched.count() + rest.count() == 5001


def test_repeated_rows_are_one_place(docs_of):
    docs = docs_of([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])
    assert found(docs, 5) == Counter({(2, 0, 1, 0, True): 1})


def test_no_python_and_few_rows_for_a_hot_line(spark, docs_of):
    docs = docs_of([f"one line that many share\nand number {i} of a row" for i in range(400)])
    made = repeated_lines(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
    assert made.count() == 399 + 399
