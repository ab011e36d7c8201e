import hashlib
import re

from wayfare.llm.secrets import op7_secret_scan, scan_secrets

PATTERNS = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
SCHEMA = "doc_id long, text string, source string, n_chars long, start long"


def base(text):
    spans = sorted((m.start(), nr, f"{kind}:{m.start()}:{m.end()}") for nr, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))
    return [x[2] for x in spans]


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: base(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op7_secret_scan(spark, d).collect()
    assert len(got) == len(want) and sum(map(len, want.values())) > 10
    for r in got:
        assert r.base_sha256 == digest(want[r.doc_id])
        assert set(want[r.doc_id]) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want[r.doc_id]) for k in ("assign:", "access:", "hex:"))


def test_edges_and_ownership(spark, tmp_path):
    copied, own = "AKIA" + "X" * 16, "ghp_" + "a1B2" * 9
    texts = [
        (1, f"é😀 key {copied}", "a"), (2, copied, "b"), (3, f"{copied} {copied}", "c"), (4, f"x {own} y", "a"), (5, None, None), (6, "", "a"),
        (7, "token: token : abcdefg", "a"), (8, "TOKEN = 'abc' secret=\"abcdef1\" api_key:ABCDEFGH", "b"), (9, "0123456789abcdef" * 2000, "b"),
        (4, f"x {own} y", "a"), (None, "password=hunter22", None),
    ]
    spark.createDataFrame([(i, t, s, 0, 1) for i, t, s in texts], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op7_secret_scan(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.base_sha256) for r in rows) == sorted((i or 0, digest(base(t))) for i, t, _ in texts)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_example == 2 and by[3].n_live == 0
    assert by[4].spans == f"service:2:{2 + len(own)}" and by[4].n_live == 1
    assert by[7].spans == "" and by[5].spans == "" and by[9].n_hex == 1
    full = scan_secrets(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("doc_id = 1").first()
    assert full.spans[0].owners == 3 and full.spans[0].repositories == 3


def test_empty(spark):
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
