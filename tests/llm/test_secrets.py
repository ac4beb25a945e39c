"""Base spans against Python's re; ownership by counting; redaction."""

import hashlib
import re

from tallyward.llm import queries, secrets

from .helpers import docs, rows

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def expected(text):
    found = base(text)
    return [sum(x[1] == k for x in found) for k in range(3)] + [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()]


def test_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(queries.op3_secrets(spark, sf))
    assert len(got) == len(texts) and any(base(t) for t in texts.values())
    for i, text in texts.items():
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == expected(text), i


CASES = [
    None, "", "password=abcdefghijkl", "password: 'short' token = \"A.b-c_d=e+f/g123\"", 'secret: "token: abcdefghijklmn"', "😀 api_key=😀 API_KEY='aaaaBBBB1111' é",
    "AKIAAKIAAKIAAKIA12 AKIA12", "deadbeefdeadbeef0" * 3 + "g" + "a" * 15, "tokentoken=tokentoken=xx:yyyyyyyyyyyyyyyy", "passwd=" + "x1" * 3000,
    "token=abcdefghijkl" * 300, "Token\u212aey api\u212aey=abcdefghijklmnop", "apikey=0123456789abcdef0123",
]


def test_edges(spark):
    got = rows(secrets.scan(docs(spark, CASES)))
    for i, text in enumerate(CASES):
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["base_sha256"]] == expected(text), text


def test_repeated_rows_and_clashing_columns(spark):
    d = docs(spark, [(1, "token=abcdefghijkl9"), (1, "token=abcdefghijkl9"), (None, "no"), (None, "AKIA" + "B" * 20)]).selectExpr("*", "1 AS kind", "2 AS row", "3 AS hash")
    got = secrets.scan(d).collect()
    assert sorted((r["doc_id"] or -1, r["n_assign"], r["n_access"]) for r in got) == [(-1, 0, 0), (-1, 0, 1), (1, 1, 0), (1, 1, 0)]
    assert {r["spans"] for r in got if r["doc_id"] == 1} == {"assign:0:19"}
    assert secrets.redact(d).columns == d.columns


def test_ownership(spark):
    own, copied = "Zq8Kd03mVx71LpTe92Rb", "Yw5Hc27nUg64JsFa81Xo"
    d = docs(spark, [f"see {own} here", f"see {copied} here", f"a {copied} b", f"token={own}z"], source=["a", "a", "b", "a"])
    got = rows(secrets.scan(d))
    assert got[0]["spans"] == "owned:4:24" and got[1]["spans"] == "" == got[2]["spans"]
    assert got[3]["spans"].startswith("assign:0:") and got[3]["n_live"] == 1
    masked = rows(secrets.redact(d))
    assert masked[0]["text"] == f"see {secrets.MASK} here" and masked[1]["text"] == f"see {copied} here" and masked[3]["text"] == secrets.MASK


def test_token_in_many_documents_of_one_source(spark):
    spread, own = "Zq8Kd03mVx71LpTe92Rb", "Yw5Hc27nUg64JsFa81Xo"
    texts = [f"see {spread} in {i}" for i in range(secrets.SPREAD - 1)] + [f"token={spread}"]
    texts += [f"see {own} in {i}" for i in range(secrets.SPREAD - 2)] + [f"token={own}"]
    got = rows(secrets.scan(docs(spark, texts)))
    last, other = secrets.SPREAD - 1, len(texts) - 1
    assert {got[i]["spans"] for i in range(last)} == {""}
    assert (got[last]["n_live"], got[last]["n_copied"]) == (0, 1)
    assert {got[i]["spans"] for i in range(last + 1, other)} == {"owned:4:24"}
    assert (got[other]["n_live"], got[other]["n_copied"]) == (1, 0)


def test_empty(spark):
    assert secrets.scan(docs(spark, ["x"]).limit(0)).count() == 0


def plain_spans(rows_):
    """What the scan has to give, in plain Python: (base, all) of each (owner, repository, text)."""
    base = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
    }
    extra = re.compile(r"[A-Za-z0-9+/_-]{20,}")

    def live(v):
        return re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 8 and not re.search(r"(?i)example|sample|changeme|placeholder|x{4,}|1234|abcd", v)

    owners, repos, found = {}, {}, []
    for owner, repo, text in rows_:
        mine, more = [], []
        for k, (kind, (p, g, least)) in enumerate(base.items()):
            mine += [(m.start(), k, m.end(), kind, m[g]) for m in p.finditer(text) if len(m[g]) >= least]
        more = [(m.start(), 3, m.end(), "owned", m[0]) for m in extra.finditer(text) if live(m[0])]
        for *_, value in mine + more:
            owners.setdefault(value, set()).add(owner)
            repos.setdefault(value, set()).add(repo)
        found.append((sorted(mine), more))
    out = []
    for mine, more in found:
        more = [x for x in more if len(owners[x[4]]) < 2 and len(repos[x[4]]) < 50 and not any(x[0] < y[2] and y[0] < x[2] for y in mine)]
        show = lambda xs: ",".join(f"{kind}:{a}:{z}" for a, _, z, kind, _ in sorted(xs))
        out.append((show(mine), show([*mine, *more])))
    return out


def test_against_plain_python(spark, sf):
    given = [(r["source"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mine, both, wide = "Zk3vQ9tLw0RbYx7NhUeP", "pL5mW2sVd8Gf6Jq1TzCy", "aB9cD8eF7gH6iJ5kL4mN"
    given += [("a", f"é {mine} token = {mine[:15]}"), ("a", f"x {both}"), ("b", f"{both} AKIA{'Q7' * 9}"), ("c", "0123456789abcdef0123 api_key:'aaaa'")]
    given += [("a", f"run {wide} now {i}") for i in range(60)]
    d = docs(spark, [t for _, t in given], source=[s for s, _ in given])
    got = rows(secrets.scan(d))
    want = plain_spans([(s, i, t) for i, (s, t) in enumerate(given)])
    assert {i: (hashlib.sha256(b.encode()).hexdigest(), a) for i, (b, a) in enumerate(want)} == {i: (r["base_sha256"], r["spans"]) for i, r in got.items()}
    assert any("owned" in a for _, a in want)
