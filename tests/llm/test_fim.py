"""Units, cuts and orders against the pattern, and exact round trips."""

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from wayfare.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.text(alphabet="ab <P>SM\t\n\x0b\x0c\r\x1c\x85\xa0 é\U0001f600", max_size=40))
def test_units_are_the_pattern_s(text):
    ends, marked = fim.unit_ends(text)
    assert ends.tolist() == [m.end() for m in UNIT.finditer(text)]
    assert marked == any(x in text for x in fim.SENTINELS)


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= 50:
        return (n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_whole_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [None, "", " ", "\n\n", "a", " a", "a ", "<", "x<P", "x<P>y", "<S>", "<<M>", "é \U0001f600\U0001f600  b\t", "\x85 \xa0 ", "w " * 200_000, "z" * 300_000, "<P <S <M < P>"]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k * 100 + i, x) for i, x in enumerate(odd) for k in range(6)] + [(None, "no id"), (3, "same id"), (3, "same id")], "doc_id long, text string"))
    more = docs.withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("_text", F.lit(3)).withColumn("_cut", F.lit(4))
    made = fim.fill_in_middle(more)
    assert made.columns == ["doc_id", "text", "a.b", "_text", "_cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and (r["a.b"], r["_text"], r["_cut"]) == (2, 3, 4)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
