"""Operators that look at one row at a time, against plain Python and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import licenses, pii, token_counts, toxicity, url_rules

AWKWARD = [
    (1, "plain words here"), (2, None), (3, ""), (4, " \t\n "), (4, " \t\n "), (None, "no id"), (5, "word " * 40_000), (6, "é" * 5000), (7, "a\x00b"), (8, "1" * 50_000), (9, "@" * 3000), (10, "." * 3000),
]


def table(spark, rows=AWKWARD):
    """Extra columns carry the names that the operators use inside."""
    full = [(i, t, "x", 1, t, "y", 0.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, c string, n long, id string, size string, score double")


def luhn_ok(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base_spans(text):
    """The base kinds by their expressions over the whole text."""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn_ok(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


PARTS = ["a@b.co", "x.y%z+1@mail-1.ex.org", "@", ".", "1.2.3.4", "256.1.1.1", "01.002.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "++49 30 1234567", " ", "-", "é", "7", "word", "\n", "a@b@c.de", "..", "http://x.org/p?q=1."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_pii_base_spans_equal_the_expressions(parts):
    text = "".join(parts)
    got = pii.find_spans(text)
    assert {k: got[k] for k in pii.BASE} == base_spans(text)


def test_pii_added_kinds():
    text = "See https://ex.org/a?b=c, or (ftp://f.ex.org). Visit 12 Long Oak Street or 5b Elm Avenue. IBAN: GB82 WEST 1234 5698 7654 32 and account no. 12-345678. Streets of Roads."
    got = pii.find_spans(text)
    cut = lambda k: [text[a:b] for a, b in got[k]]
    assert cut("url") == ["https://ex.org/a?b=c", "ftp://f.ex.org"]
    assert cut("address") == ["12 Long Oak Street", "5b Elm Avenue"]
    assert cut("account") == ["GB82 WEST 1234 5698 7654 32", "12-345678"]


def test_pii_account_ends_at_any_group():
    found = lambda t: [t[a:b] for a, b in pii.find_spans(t)["account"]]
    assert found("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF") == ["DE89 3704 0044 0532 0130 00"]
    assert found("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX and IBAN GB82 WEST 1234 5698 7654 32 OK") == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert found("IBAN DE89370400440532013000 BIC COBADEFF") == ["DE89370400440532013000"]
    assert found("IBAN DE89 3704 0044 0532 0130 00 BIC Deutsche Bank") == ["DE89 3704 0044 0532 0130 00"]
    assert found("IBAN DE89 3704 0044 0532 0130 00 Bank") == ["DE89 3704 0044 0532 0130 00"]
    assert found("IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFF") == []


def test_pii_boundaries_and_cues():
    def cut(text, kind):
        return [text[a:b] for a, b in pii.find_spans(text)[kind]]

    far = "12 " + "Very" * 200 + " Long Oak Street"
    assert cut("at " + far + " now", "address") == [far]
    assert cut("99912345678 Oak Street", "address") == [] and cut("12 Oak St. and 7 ELM AVENUE, (9b Fir Road)", "address") == ["12 Oak St.", "7 ELM AVENUE", "9b Fir Road"]
    assert cut("12 a Oak Street 1 B C D E F Street x12 Oak Street", "address") == [] and cut("Street", "address") == []
    assert cut("xhttp://a.b HTTP://c.de", "url") == ["HTTP://c.de"]
    assert cut("SSN 123-45-6789, ssn: 000-12-3456, Passport no. C01234567", "ident") == ["123-45-6789", "C01234567"]
    assert cut("ACCOUNT 12345678", "account") == ["12345678"]
    key = "AKIA" + "Z9" * 8
    assert cut(f"key {key}, x{key} token = \"f32ab9ba2834a0d3\" password: hello", "secret") == [key, "f32ab9ba2834a0d3"]
    assert cut(f"token={key}", "secret") == [key]
    assert pii.find_spans("Street " * 20_000 + "A" * 100_000 + " Street" * 3)["address"] == []


def test_pii_table(spark):
    rows = [*AWKWARD, (11, "mail a.b@c.org or 10.0.0.1")]
    got = pii.find_pii(table(spark, rows)).collect()
    assert len(got) == len(rows)
    last = next(r for r in got if r.doc_id == 11)
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 0, 0) and last.spans == "email:5:14,ip:18:26"
    assert last.base_sha256 == hashlib.sha256(b"email:5:14,ip:18:26").hexdigest()
    assert next(r for r in got if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(table(spark, [])).count() == 0
    masked = pii.mask_pii(table(spark, rows)).where("doc_id in (2, 11)").collect()
    assert sorted(str(r.text) for r in masked) == ["None", "mail <email> or <ip>"]
    odd = spark.createDataFrame([("a@b.co", "x", "a@b.co"), ("", None, None)], "text string, __text string, masked string")
    assert sorted(map(tuple, pii.mask_pii(odd).collect())) == [("", None, None), ("<email>", "x", "a@b.co")]
    assert pii.mask_pii(odd.limit(0)).count() == 0


def by_rules(url):
    """Every rule tried on every URL."""
    host, path = url_rules.split_url(url)
    fits = [r for r in url_rules.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)] if host or path else []
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.action
    for p in url_rules.PATTERNS:
        if (host or path) and re.fullmatch(p.host, host, re.S) and re.fullmatch(p.path, path, re.S):
            return host, path, None, p.action
    return host, path, None, "allow"


URLS = ["http://A.Example.COM/en/7x?q", "https://example.com/en/8", "http://example.net/de/81#x", "http://b.example.net/de/7", "net/de/", "http://", "http:///en/", "x://notexample.com/en/7", "http://org/es/", "http://www.casino-win.org/fr", "http://x.net/a/wp-login.php", "http://10.0.0.1:80/", "http://com?/en/", "http://com/en", "http://a\nb.com/en/1", None, "", "http://x/a.com\x00/en/", "http://a\x00b.com/en/", "http://x\x00.org/es/1"]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, u, "z") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df).collect()}
    assert got == {k: by_rules(u) for k, u in enumerate([*URLS, *URLS])}
    assert got[0][2:] == ("example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("example.net/de/8", "block")
    assert got[7][2:] == ("com/en/", "block") and got[9][3] == "block" and got[15] == ("", "", None, "allow")
    assert got[17][2:] == (None, "allow") and got[18][2:] == ("com/en/", "block") and got[19][2:] == ("org/es/", "block")
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_url_index_runs_few_rules():
    rules = [url_rules.UrlRule("block", f"site{k}.com", "/x") for k in range(2000)]
    index = url_rules.RuleIndex(rules)
    assert max(map(len, index.by_token.values())) == 1
    assert [rules[k].host for k in index.matches("a.site77.com", "/xy", {"a", "site77", "com", "xy"})] == ["site77.com"]


def plain_count(pieces, word, byte, longest=10_000):
    """Best segmentation by the textbook recursion over all cuts."""
    text = token_counts.MARK + word
    best = [(0.0, 0)]
    for j in range(1, len(text) + 1):
        n = len(text[j - 1].encode())
        options = [(best[j - 1][0] + byte * n, best[j - 1][1] - n)]
        options += [(best[i][0] + pieces[text[i:j]], best[i][1] - 1) for i in range(max(0, j - longest), j) if text[i:j] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark):
    pieces = token_counts.load_pieces()
    assert abs(sum(map(math.exp, pieces.values())) - 1) < 1e-9
    trie = token_counts.TokenTrie(pieces)
    rng = random.Random(3)
    words = ["the", "", "naïve", "日本", "a" * 300, *("".join(rng.choice("etaonhéx") for _ in range(rng.randint(1, 14))) for _ in range(300))]
    for w in words:
        assert trie.count(w) == plain_count(pieces, w, trie.byte)
    before = trie.nodes
    long = "".join(rng.choice("etaonhéx") for _ in range(20_000))
    assert trie.count(long) == plain_count({p: s for p, s in pieces.items() if set(p) <= set("etaonhéx" + token_counts.MARK)}, long, trie.byte, trie.longest)
    assert trie.nodes <= before + token_counts.DEPTH and long not in trie.terminal  # a long word fills no memory
    before = trie.nodes
    trie.count(words[-1] + "zz")
    assert trie.nodes <= before + 2  # the shared prefix is there already
    got = token_counts.count_tokens(table(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert next((r.n_words, r.n_tokens) for r in got if r.doc_id == 5) == (40_000, 40_000 * trie.count("word"))
    assert next((r.n_words, r.n_tokens) for r in got if r.doc_id == 2) == (0, 0)
    assert token_counts.count_tokens(table(spark, [])).count() == 0


def test_token_counts_in_columns(spark, monkeypatch):
    trie = token_counts.TokenTrie(token_counts.load_pieces())
    table_of = token_counts.PieceTable(trie)
    rng = random.Random(4)
    words = ["".join(rng.choice("etaonhéx日\0😀") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    words += ["a", "a\0", "a\0b", "a\0\0", "the", "them", "theme", "the", "e" * 63, "e" * 64, "e" * 65]
    monkeypatch.setattr(token_counts, "CELLS", 64 * 300)
    expected = [trie.count(w) for w in words]
    met = []
    monkeypatch.setattr(trie, "count", lambda w, count=trie.count: met.append(w) or count(w))
    assert table_of.count(words).tolist() == expected
    assert set(met) == {w for w in words if len(w) >= token_counts.DEPTH}  # the others are counted at once, not one by one
    assert token_counts.PieceTable(token_counts.TokenTrie({})).count(["a", "日"]).tolist() == [4, 6]


FULL = {p: t for p, t in licenses.known_texts() if t.count(" ") > 40}


def wraps(text):
    """The text at many widths, paragraph by paragraph, unwrapped, and as comments."""
    import textwrap

    parts = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text)]
    for width in (*range(60, 101, 4), 79, 1_000_000):
        yield "\n\n".join(textwrap.fill(p, width) for p in parts)
    yield "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(parts[0], 70)) + "\n *\n" + "\n *\n".join("\n".join(" * " + x for x in textwrap.wrap(p, 70)) for p in parts[1:]) + "\n */"


@pytest.mark.parametrize("name", sorted(FULL))
def test_every_license_at_every_width(name):
    known = licenses.known_digests()
    for text in [t for n, t in licenses.known_texts() if n == name and t.count(" ") > 40]:
        for form in wraps(text):
            assert known.get(licenses.digest(form)) == name
    for form in wraps(FULL[name]):
        assert licenses.digest(form + "\n\nBut not for you.") not in known
        assert licenses.digest(re.sub(r"(?i)\bor\b", "nor", form, count=1)) not in known


def test_copyright_notices():
    same = ["Copyright (c) 2020 Some One <a@b.c>, and others\n\nWords", "words", "© 2019-2024 Else. All rights reserved.\nWORDS", "Copyright by the authors of this\nthing\n\nwords", "# (C) Copyright 1999\n#\n# words"]
    assert len({licenses.digest(t) for t in same}) == 1
    for t in ("copyright holders be liable", "copyright notice above", "(c) the third", "copyright 2020 " + "x " * 200):
        assert licenses.canonical(t) == " ".join(re.findall("[a-z0-9]+", t))
    assert licenses.canonical("Copyright 2020 A. Licensed under the MIT Licence.") == "licensed under the mit license"


def test_licenses(spark):
    mit = FULL["MIT"].split("\n", 1)[1] if FULL["MIT"].startswith("MIT") else FULL["MIT"]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-license") + "\n"
    notices = "text\n  licensed under the APACHE license - version 2.0!\nReleased under the MIT Licence\nReleased under the MIT License."
    rows = [*AWKWARD, (20, changed), (21, mit + " more"), (22, notices), (22, notices), (23, "Copyright 2024 Me")]
    got = licenses.scan_licenses(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[20].license == "MIT" and by[21].license is None and by[1].license is None
    assert [(r.n_notices, r.notices) for r in got if r.doc_id == 22] == [(3, "Apache-2.0,MIT")] * 2
    assert by[2].digest == by[3].digest == by[23].digest == hashlib.md5(b"").hexdigest() and by[2].license is None
    assert licenses.scan_licenses(table(spark, [])).count() == 0
    own = licenses.scan_licenses(table(spark, [(1, "My OWN terms."), (2, "x\nmy own terms")]), texts=[("own", "my own terms"), ("none", "--")])
    assert sorted((r.doc_id, r.license, r.notices) for r in own.collect()) == [(1, "own", "own"), (2, None, "own")]


def test_licenses_equal_their_sql(spark):
    """The query's SQL on documents that hold known texts, which the test tables don't."""
    import duckdb

    rows = [(k, form) for k, form in enumerate(f for n in sorted(FULL) for f in list(wraps(FULL[n]))[::5])] + [(900, None), (901, ""), (902, "© 2020 A & B“\n\nreleased under the mit licence"), (903, "Copyright 2020 é" + "x" * 400)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = c.execute("SELECT doc_id, digest, license, n_notices, notices FROM (" + licenses.oracle_sql() + ")").fetchall()
    got = [tuple(r) for r in licenses.scan_licenses(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(g[2] is not None for g in got) == len(rows) - 3


def labelled(n=3000, seed=1):
    """Toxic only where an insult and a group meet; each alone is clean."""
    rng = random.Random(seed)
    insults, groups = ["scumlord", "moronic", "vilething"], ["lefties", "northerners", "gamers"]
    rows = []
    for k in range(n):
        kind = rng.randrange(4)
        words = [f"w{rng.randrange(400)}" for _ in range(25)]
        if kind in (1, 3):
            words.append(rng.choice(insults))
        if kind in (2, 3):
            words.append(rng.choice(groups))
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(kind == 3)))
    return rows


def test_toxicity_learns_pairs(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got.values())


def matched(n=3000, seed=4):
    """Toxic where word and group match; no word says anything alone."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        i, j = rng.randrange(2), rng.randrange(2)
        words = [f"w{rng.randrange(400)}" for _ in range(25)] + [("scumlord", "vilething")[i], ("lefties", "northerners")[j]]
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(i == j)))
    return rows


def test_toxicity_lives_on_pairs(spark):
    """Without single effects only the pair factors can tell; without them the model is a coin."""
    rows = matched()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    flat = toxicity.FactorizationMachine(model.w0, model.terms, model.w, model.v * 0)
    truth = {i: y for i, _, y in rows}

    def accuracy(m):
        return np.mean([r.predicted == truth[r.doc_id] for r in toxicity.score_texts(docs, m).where("held_out").collect()])

    assert accuracy(model) > 0.95 and accuracy(flat) < 0.65 and np.abs(model.v).max() > 0.3


def test_toxicity_bounds(spark, monkeypatch):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "fit_sample", lambda s, inner: sizes.append((len(s.labels), len(s.flat), int(inner.sum()))))
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, max_rows=50)
    monkeypatch.setattr(toxicity, "MAX_TERMS", 500)
    toxicity.train(docs, labels)
    assert sizes[0][0] > 200 and sizes[1][0] == 50 and sizes[2][1] <= 500 and 0 < sizes[2][0] < 50
    assert sizes[0][2] == sum(zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows)


def test_toxicity_model_formula():
    m = toxicity.FactorizationMachine(-0.5, np.array([3, 9, 40]), np.array([0.2, -0.1, 0.4]), np.array([[1.0, 0.5], [-0.3, 0.2], [0.7, 0.1]]))
    present = [[0, 1, 2], [], [1, 2]]
    doc, idx = np.repeat(range(3), [3, 0, 2]), np.array([0, 1, 2, 1, 2])
    for got, on in zip(m.scores(3, doc, idx), present, strict=True):
        z = m.w0 + sum(m.w[i] for i in on) + sum(m.v[i] @ m.v[j] for i in on for j in on if i < j)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-12
    assert list(m.finder()(np.array([9, 10, 3]))) == [1, -1, 0]


@pytest.mark.parametrize("labels", [[], [(1, 0), (3, None), (None, 1)], [(1, 1)]])
def test_toxicity_awkward_tables(spark, labels):
    lab = spark.createDataFrame([(i, y, "q") for i, y in labels], "doc_id long, toxic int, text string")
    got = toxicity.score_toxicity(table(spark), lab).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(table(spark, []), lab).count() == 0
