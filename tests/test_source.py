"""Source texts character by character, and what is read out of rendered documents."""

import random

from pyspark.sql import functions as F

from lodeweave.functions import source, text


def scanned(code, slash):
    """Comments out, one character after the other."""
    out, i = [], 0
    while i < len(code):
        c = code[i]
        if not slash and code[i : i + 3] in ('"""', "'''"):
            end = code.find(code[i : i + 3], i + 3)
            out.append(" ")
            i = len(code) if end < 0 else end + 3
            continue
        if c in "\"'":
            j = i + 1
            while j < len(code) and code[j] not in (c, "\n"):
                j += 2 if code[j] == "\\" and j + 1 < len(code) else 1
            if j < len(code) and code[j] == c:
                out.append(code[i : j + 1] + " ")
                i = j + 1
                continue
        elif slash and code[i : i + 2] == "/*":
            end = code.find("*/", i + 2)
            out.append(" ")
            i = len(code) if end < 0 else end + 2
            continue
        elif code[i : i + 2] == "//" if slash else c == "#":
            end = code.find("\n", i)
            out.append(" ")
            i = len(code) if end < 0 else end
            continue
        out.append(c)
        i += 1
    return "".join(out)


def test_comments_and_strings(spark):
    draw = random.Random(7)
    codes = ["".join(draw.choice(["/", "/", "*", "//", "/*", "*/", '"', "'", '"""', "'''", "#", "\\", "\n", "a", " ", "é"]) for _ in range(draw.randrange(25))) for _ in range(3000)]
    codes += ['"' + "x" * 200_000 + '"//y', "/*" + "z" * 200_000, '"' + '\\"' * 50_000 + '" // end']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i long, c string")
    for extension, slash in ((".cpp", True), (".Go", True), (".py", False)):
        got = {r["i"]: r["t"] for r in rows.select("i", source.without_comments(F.col("c"), F.lit(extension)).alias("t")).collect()}
        for i, c in enumerate(codes):
            assert got[i] == scanned(c, slash), (extension, c[:50])
    assert rows.filter(source.without_comments(F.col("c"), F.lit(".txt")) != F.col("c")).isEmpty()


def test_globals(spark):
    rows = [
        ('int f(int MAX_LEN) { // OLD_ONE\n  vtop++; x = 1;\n  error_count += 1;\n  file->pos = g_top; if (cur_scope == MAX_LEN) return EXIT_CODE; }', ["int MAX_LEN"], ".c", ["EXIT_CODE", "cur_scope", "error_count", "file", "g_top", "vtop"]),
        ('def f(a):\n    """USES_DOC"""\n    global total, n_seen  # why\n    return "IN_TEXT" + HTTP + LIMITS', ["a"], ".py", ["IN_TEXT", "LIMITS", "n_seen", "total"]),
        ("x = 1", None, None, []),
        (None, None, ".c", None),
        ("let AB = ABC; let ABCD = A_B;", [], ".ts", ["ABCD", "A_B"]),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i long, s string, p array<string>, e string")
    got = {r["i"]: r["g"] for r in df.select("i", source.referenced_globals(F.col("s"), F.col("p"), F.col("e")).alias("g")).collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}


def test_documents_read_back(spark):
    module = "# m.x\n\n| Name | Sig | Text |\n| [f](f.md) | `int f()` | — |\n| [g | `h` | two words |\n| [k](k.md) | `k` |\n| [short\n" + "." * 40
    rows = spark.createDataFrame([(module,), ("# m\n| [f](f.md) | `f` | x |",), ("| [f](f.md) | `f` | x |" + " " * 60,), (None,)], "d string")
    got = [r[0] for r in rows.select(source.module_functions(F.col("d"))).collect()]
    assert got == [["f: int f()", "[g: h — two words", "k: k"], None, None, None]
    trees = spark.createDataFrame([("- `a.b`\n├── c → d\n└── c\n  │── e\n* f(x)\nplain\n\n",), ("",), (None,)], "t string")
    assert [r[0] for r in trees.select(source.callee_names(F.col("t"))).collect()] == [["a.b", "c", "e", "f"], [], None]
    docs = spark.createDataFrame([("中文: 甲\nEnglish： b ",), ("One. Two.",), ("none",), ("English: only",)], "d string")
    assert [tuple(r[0]) for r in docs.select(source.descriptions(F.col("d"))).collect()] == [("甲", "b", None), (None, None, "One."), (None, None, "none"), (None, "only", None)]


def test_query_tokens_with_other_punctuation(spark):
    rows = spark.createDataFrame([("排序，列表。sort：list",), ("a、bc；de！fg？",), ("Quick-Sort (x) of_lists",)], "q string")
    assert [r[0] for r in rows.select(text.query_tokens(F.col("q"))).collect()] == [["排序", "列表", "sort", "list"], ["bc", "de", "fg"], ["quick-sort", "of_lists"]]
