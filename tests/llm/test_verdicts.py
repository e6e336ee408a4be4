"""Fitted verdicts computed again plainly: language posteriors, outlier distances, random spans."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DATA, documents

from threshcast.llm import language, quality, queries, secrets


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()


# -- language ---------------------------------------------------------------------------------


def plain_bins(text):
    """Bins of the trigrams of letters with single blanks, one character after another."""
    seen, out = b"", []
    for c in b" " + (text or "").encode().lower() + b" ":
        letter = 97 <= c <= 122 or c >= 128
        if letter or not seen or seen[-1] != 32:
            seen += bytes([c if letter else 32])
    for a, b, c in zip(seen, seen[1:], seen[2:]):
        if b != 32:
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            out.append(((h ^ (h >> 15)) * 0x27D4EB2F % 2**32) >> 17)
    return out


def test_language_equals_plain_bayes(spark, rows):
    """Trigram counts, grouped priors and posteriors of all documents, in plain Python."""
    n, codes = defaultdict(Counter), ["de", "en", "es", "fr"]
    bins = [plain_bins(r.text) for r in rows]
    for r, b in zip(rows, bins):
        if r.text is not None and r.lang in codes:
            n[r.lang].update(b)
    total = {k: sum(n[k].values()) for k in codes}
    even = 0.1 / language.BINS
    log = lambda k, b: math.log(0.9 * (n[k][b] + 0.01) / (total[k] + 0.01 * language.BINS) + even)

    def normal(logs):
        p = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(p) for x in p]

    sums = [[sum(log(k, b) for b in found) for k in codes] for found in bins]
    shared = [[s * min(len(b) / 4.0, 400.0) / max(len(b), 1) for s in x] for x, b in zip(sums, bins)]
    text = [normal(x) for x in shared]
    every = [1.0 + sum(p[i] for p in text) for i in range(4)]
    share = [x / sum(every) for x in every]
    said = {v: [sum(p[i] for p, r in zip(text, rows) if r.lang == v) for i in range(4)] for v in codes}
    host = {s: [sum(p[i] for p, r in zip(text, rows) if (r.source or "") == s) for i in range(4)] for s in {r.source or "" for r in rows}}
    found = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, DATA).collect()}
    strength = language.STRENGTH
    for r, x, b, s in zip(rows, shared, bins, sums):
        h = host[r.source or ""]
        logs = []
        for i in range(4):
            # the domain of a plain source is the source itself
            parent = (h[i] + strength * share[i]) / (sum(h) + strength)
            prior = (h[i] + strength * parent) / (sum(h) + strength)
            logs.append(x[i] + math.log((said[r.lang][i] + 0.5) / (every[i] + 0.5 * 5)) + math.log(prior))
        p = normal(logs)
        far = len(b) >= 40 and max(s) / max(len(b), 1) < -math.log(language.BINS) - 1.0
        known = len(b) >= 3 and not far
        got = found[r.doc_id]
        assert got.posterior == pytest.approx(max(p), rel=1e-6) and got.letters == len(b)
        assert got.language == (codes[p.index(max(p))] if known else "und")
        assert got.kept == (known and max(p) >= 0.5)


def test_suffix_and_host_of_pages_move_the_verdict(spark):
    """The text says little; the address suffix and the host's other pages tell."""
    texts = {"de": "der die und nicht ein ist das mit", "en": "the and of that with this from have"}
    docs = documents(spark, [texts["de"], texts["en"]] * 20)
    labelled = docs.withColumn("lang", queries.F.when(docs.doc_id % 2 == 0, "de").otherwise("en"))
    model = language.fit_text(labelled)
    pages = [(i, f"https://www.a{i % 3}.{'de' if i % 2 else 'uk'}/x", texts["de" if i % 2 else "en"]) for i in range(60)]
    pages += [(90, "https://www.a1.de/y", "in an am"), (91, "https://www.a2.uk/y", "in an am")]
    table = spark.createDataFrame(pages, "page_id long, url string, text string")
    hint = {"address": queries.F.col("url")}
    out = language.identify(table, language.fit(table, model, **hint), **hint)
    told = {r.page_id: r._language.language for r in out.collect()}
    assert told[90] == "de" and told[91] == "en"


# -- quality ----------------------------------------------------------------------------------


def plain_quantile(x, q):
    """The least value with at least a share q of the values at or below it."""
    x = np.sort(x)
    return x[max(0, math.ceil(q * len(x)) - 1)]


def plain_mcd(x):
    """(centre, precision) by the same concentration steps, on arrays."""
    k = x.shape[1]
    floors = np.diag(np.square(quality.FLOORS))
    centre = np.array([plain_quantile(x[:, i], 0.5) for i in range(k)])
    spread = [1.4826 * plain_quantile(np.abs(x[:, i] - centre[i]), 0.5) for i in range(k)]
    scatter, last = np.diag(np.square(spread)) + floors, None
    away = lambda: np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter), x - centre)
    dets = []
    for _ in range(quality.STEPS):
        d2 = away()
        core = x[d2 <= plain_quantile(d2, quality.CORE)]
        centre, scatter = core.mean(axis=0), np.cov(core.T, bias=True) + floors
        dets.append((centre, scatter))
        last = scatter
    assert last is not None
    return dets


def test_distances_equal_plain_mcd(spark, rows, monkeypatch):
    """Every group's distances after some number of steps; the verdict is the distance's."""
    monkeypatch.setattr(quality, "STILL", -1.0)  # all steps, so both take as many
    monkeypatch.setattr(quality, "STEPS", 4)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = quality.judge(docs).collect()
    limit = quality.chi_square_above(quality.TAIL, 4)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and (r.distance is None or r.distance <= limit))
    groups = defaultdict(list)
    good = [r for r in found if not r.base_failed]
    sizes = Counter((r.lang, r.source) for r in good)
    small = Counter()
    for (lang, _), n in sizes.items():
        small[lang] += n if n < quality.LEAST_ROWS else 0
    rest = sum(n for n in small.values() if n < quality.LEAST_ROWS)
    for r in good:
        own = sizes[r.lang, r.source] >= quality.LEAST_ROWS
        pooled = small[r.lang] >= quality.LEAST_ROWS
        name = (r.lang, r.source) if own else (r.lang,) if pooled else () if rest >= quality.LEAST_ROWS else None
        groups[name].append(r)
    compared = 0
    for name, members in groups.items():
        if name is None:
            assert all(r.distance is None for r in members)
            continue
        w = np.array([max(r.n_words, 1) for r in members], float)
        raw = np.array([[r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in members], float)
        x = np.column_stack([np.log(raw[:, 0] / w), *[np.log1p(raw[:, i] / np.sqrt(w)) for i in (1, 2, 3)]])
        centre, scatter = plain_mcd(x)[-1]
        d2 = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter), x - centre)
        scale = max(plain_quantile(d2, 0.5) / quality.chi_square_above(0.5, 4), 1.0)
        got = np.array([r.distance for r in members])
        assert got == pytest.approx(d2 / scale, rel=1e-6, abs=1e-9)
        compared += len(members)
    assert compared > 100


# -- secrets ----------------------------------------------------------------------------------


def plain_model(texts):
    """Log-likelihood ratios by counting neighbouring characters of both classes."""
    alphabet = secrets.ALPHABET
    seen = [Counter(), Counter()]
    for text in texts:
        if text is None:
            continue
        values = [m[2] for m in re.finditer(secrets.ASSIGN, text)]
        values += re.findall(secrets.ACCESS, text) + re.findall(secrets.HEX, text)
        rest = text
        for pattern in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX):
            rest = re.sub(pattern, " ", rest)
        tokens = [(1, re.sub(r"[^A-Za-z0-9+/_=-]", "-", v)) for v in values if len(v) >= 6]
        tokens += [(0, t) for t in re.findall(secrets.TOKEN + "{4,}", rest)]
        for kind, token in tokens:
            seen[kind].update(zip(token, token[1:]))
    logs = []
    for table in seen:
        every = sum(table.values()) + len(alphabet) / 2
        second = {b: (sum(table[a, b] for a in alphabet) + 0.5) / every for b in alphabet}
        own = {}
        for a in alphabet:
            whole = sum(table[a, b] for b in alphabet)
            for b in alphabet:
                own[a, b] = math.log(0.9 * (table[a, b] + 8 * second[b]) / (whole + 8) + 0.1 / len(alphabet))
        logs.append(own)
    return {k: logs[1][k] - logs[0][k] for k in logs[0]}


def test_random_spans_equal_plain_ratios(spark, rows):
    texts = {r.doc_id: r.text for r in rows}
    model = plain_model(texts.values())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ratios = secrets.train(docs)
    assert ratios == pytest.approx([model[a, b] for a in secrets.ALPHABET for b in secrets.ALPHABET], rel=1e-9, abs=1e-9)
    clean = {r.doc_id: r.text for r in secrets.redact(docs, ratios).collect()}
    added = 0
    for r in secrets.report(docs, ratios).collect():
        text = texts[r.doc_id] or ""
        base = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s and not s.startswith("random")]
        want = []
        for m in re.finditer(secrets.TOKEN + f"{{{secrets.LEAST},}}", text):
            ratio = sum(model[p] for p in zip(m[0], m[0][1:]))
            if ratio >= secrets.THRESHOLD and not any(a < m.end() and m.start() < b for a, b in base):
                want.append((m.start(), m.end()))
        assert [f"random:{a}:{b}" for a, b in want] == [s for s in r.spans.split(",") if s.startswith("random")]
        added += len(want)
        out, at = "", 0
        for a, b in sorted([*base, *want]):
            if a >= at:
                out += text[at:a] + "<SECRET>"
            at = max(at, b)
        assert clean[r.doc_id] == (texts[r.doc_id] if not base and not want else out + text[at:])
    assert added >= 0
