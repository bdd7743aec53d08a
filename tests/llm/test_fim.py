import hashlib
import random
import re

from helpers import awkward, empty

from factloom.llm import fim

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}"


def check(df):
    rows = df.select("doc_id", "text").collect()
    out = fim.fill_in_middle(df).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((r.id, r.text, r.n, r.form, r.prefix, r.middle, r.output) for r in out), key=lambda x: key(x[:2]))
    want = sorted(((i, t or "", *plain(i, t)) for i, t in rows), key=lambda x: key(x[:2]))
    assert got == want
    assert all(r.restored == r.text and r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in out)
    return out


def test_against_plain_code(spark):
    r = random.Random(1)
    rows = [(k, "".join(r.choice(["a", "é", "日", " ", "\t", "\n", "\x0b", " ", "\x00", "<", "P>", "<P", "<S>", "'", "word"]) for _ in range(r.randint(0, 30)))) for k in range(800)]
    out = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.form for x in out} == {"plain", "spm", "psm"}


def test_awkward_rows_and_empty_tables(spark):
    check(awkward(spark).withColumnRenamed("node", "tokens"))
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_long_texts(spark):
    ids = [k for k in range(200) if plain(k, "a b")[1] != "plain"][:3]
    check(spark.createDataFrame([(ids[0], "x y " * 500_000), (ids[1], " " * 3_000_000), (ids[2], "é" * 2_000_000)], "doc_id long, text string"))


def test_rates_and_seed(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'one two three four' AS text")
    forms = lambda **k: [r.form for r in fim.fill_in_middle(docs, columns=("id", "form"), **k).orderBy("id").collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(rate=100, spm_rate=0)) == {"psm"} and forms() != forms(seed=7) and 140 < forms().count("plain") < 260
