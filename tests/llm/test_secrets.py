import hashlib
import random
import re

from helpers import DATA, documents

from threshcast.llm import queries, secrets

PLAIN = {
    "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            least = {"assign": 6, "access": 20, "hex": 24}[kind]
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check(rows, texts):
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(w[3] == kind for w in want)
        said = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [s for s in spans if not s.startswith("random")] == said
        assert len(spans) - len(said) == r.n_random


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_secret_scans"](spark, DATA).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_hard_matches(spark):
    texts = [
        "secret=token : abcdefgh", "secret=token=abcdefgh", "PassWord: 'abcde' apikey==x token:'abc.def-g", "passKword=aaaaaaa toKen=aaaaaaaa",
        "é😀 token = \"" + "0a" * 20 + "\" ü password=" + "f" * 30, "AKIA" + "A" * 16 + "b AKIA" + "B" * 15 + "AKIAAKIA" + "C" * 30,
        "0123456789abcdef" * 3 + "g" + "a" * 23 + "g" + "a" * 24, None, "", "api_key" + " " * 50 + "= " + "Zz9" * 2000, "token=\x01\x02abcdef secret\n=abcdef",
        "api key=abcdef apiKEY:abcdef api_KEY:abcdef" * 200,
    ]
    rng = random.Random(2)
    bits = ["token", "secret", "=", ":", " ", "'", '"', "ab", "cdef", "AKIA", "Q2W3", "9", "é", "_", "password"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(300)]
    df = documents(spark, texts).withColumnsRenamed({"lang": "secret_spans", "source": "_base"})
    rows = secrets.report(df, [0.0] * 67 * 67).collect()
    check(rows, dict(enumerate(texts)))
    clean = secrets.redact(df, [0.0] * 67 * 67)
    assert clean.columns == df.columns
    for r in clean.collect():
        text = texts[r.doc_id]
        spans = plain_spans(text)
        if not spans:
            assert r.text == text
            continue
        out, at = "", 0
        for a, _, b, _ in spans:
            if a >= at:
                out += text[at:a] + "<SECRET>"
            at = max(at, b)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
    assert secrets.report(df.limit(0), [0.0] * 67 * 67).collect() == []


def test_models_tell_random_from_ordinary(spark):
    rng = random.Random(9)
    parts = ["get", "User", "count", "value", "_", "list", "max", "Name", "index", "table", "read", "file"]
    word = lambda k: "".join(rng.choices(parts, k=k))
    key = lambda n: "".join(rng.choices(secrets.ALPHABET[:62], k=n))
    train = documents(spark, [f"{word(3)} {word(4)} password={key(30)} {word(5)}" for _ in range(400)])
    model = secrets.train(train)
    held = [(word(8), 0) for _ in range(200)] + [(key(32), 1) for _ in range(200)]
    rows = secrets.report(documents(spark, [f"see {t} here" for t, _ in held]), model).collect()
    right = sum((r.n_random > 0) == bool(held[r.doc_id][1]) for r in rows)
    assert right >= 0.97 * len(held), [(held[r.doc_id], r.spans) for r in rows if (r.n_random > 0) != bool(held[r.doc_id][1])][:12]
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[399] == f"random:4:{4 + 32}"
    assert len(secrets.train(train.limit(0))) == 67 * 67
