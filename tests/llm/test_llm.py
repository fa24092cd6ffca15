"""The training-data operators against brute force, exact round trips and held-out labels, on odd little tables and on the test tables."""

import hashlib
import itertools
import re

import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from hydroseries.llm import decontaminate, html_text, licenses, near_dups, neighbours, pieces, quality, secrets, token_files, toxicity

SF = f"{oracle.DATA}/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 400
TEXTS = [None, "", " ", "\n\t ", "One", "one", "a b", "A  B", LONG, LONG + "tail", "É a-b_c ÉÉ 42", "cc by", "CC--BY 4.0 x cc_by accby", "x" * 5000,
         "Licensed under the Apache License, Version 2.0. All rights reserved. GNU General Public License v3", 'token = "abcdefghijkl" AKIA0123456789ABCD 0123456789abcdef01',
         "token=secret=abcdefghijkl password: short passwd:longenough1234", "the quick brown fox jumps over the lazy dog and runs off", "the quick brown fox jumps over the lazy dog and runs away"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, f1 string, node string, spans string"


def table(spark, texts, first=0):
    rows = [(i + first, t, None, None, None, 1.0, "h", "f", "n", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_scan(spark):
    got = by_id(licenses.license_report(table(spark, TEXTS)))
    for i, text in enumerate(TEXTS):
        w = words(text)
        hits = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None)), text
        assert r.base_labels == ",".join(sorted({h[1] for h in hits})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "apache-2.0" in got[14].labels.split(",") and len(licenses.build_rules()) > 300
    assert licenses.license_report(table(spark, [])).count() == 0


def test_wrapped_license_headers(spark):
    texts = ["// Redistribution and use in source and binary\n// forms, with or without modification, are", "# Permission to use, copy, modify, and/or\n# distribute this software for any purpose",
             " * under the terms of the GNU General\n * Public License as published by the Free\n * Software Foundation; either version 2", " * Licensed under the Apache\n * License, Version\n * 2.0",
             "This is in the public\n# domain.", "/* Creative\n * Commons Attribution-\n * ShareAlike */", "Permission is\n hereby\n granted, free of charge, to any person\n obtaining a copy",
             "The 3-clause\n# BSD\n# License", "MIT\nLicense\n\n2. More", "x\ue000cc by", "x\ue001 cc by \ue000 cc by", "cc by cc by"]
    want = ["bsd", "isc", "gpl", "apache-2.0", "public-domain", "cc-by-sa", "mit", "bsd-3-clause", "mit", None, "cc-by", "cc-by"]
    got = by_id(licenses.license_report(table(spark, texts)))
    for i, label in enumerate(want):
        assert label is None or label in got[i].labels.split(","), texts[i]
        w = words(texts[i])
        hits = [k for p, _ in licenses.BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert (got[i].n_base, got[i].first_word, got[i].last_word) == (len(hits), min(hits, default=None), max(hits, default=None)), texts[i]
    assert not any(" " in rule.keyword for rule in licenses.build_rules())


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "THE quick, brown fox jumps over the lazy dog and"), (2, "a b"), (3, ""), (4, None), (5, "gamma delta"), (10, "a b")], "item_id long, text string")
    want_items = {r.item_id: words(r.text) for r in items.collect()}
    got = by_id(decontaminate.contamination(table(spark, TEXTS), items))
    for i, text in enumerate(TEXTS):
        w, hit, found = words(text), set(), set()
        for item, x in want_items.items():
            n = min(10, len(x))
            for a, b in itertools.product(range(len(x) - n + 1), range(len(w) - n + 1)) if x else ():
                if x[a:a + n] == w[b:b + n]:
                    hit |= set(range(b, b + n))
                    found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit)), text
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    left = {r.doc_id for r in decontaminate.remove_documents(table(spark, TEXTS), items).collect()}
    assert left == {i for i in got if not got[i].contaminated}
    cut = by_id(decontaminate.remove_spans(table(spark, TEXTS), items))
    assert cut[0].text is None and cut[17].text.split() == ["runs", "off"] and cut[10].text == "É_c ÉÉ 42" and cut[4].text == "One"
    twice = table(spark, ["a b", "c"]).union(table(spark, ["a b", "c"]))
    assert sorted(r.n_hit for r in decontaminate.contamination(twice, items).collect()) == [0, 0, 2, 2]
    assert decontaminate.contamination(table(spark, TEXTS), items.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("name", ["op2_benchmark_decontamination", "op7_minhash_near_dedup"])
def test_sql_twins(spark, name):
    ok, text = oracle.compare(spark, oracle.duck("sf0.001"), name, "sf0.001")
    assert ok, text


def plain_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = TEXTS + [" ".join(base)] * 3
    for k in range(60):  # a group of near copies in which some are too far away for a link
        w = list(base)
        for p in rng.choice(len(w), 1 + k // 12, replace=False):
            w[p] = f"new{k}_{p}"
        texts.append(" ".join(w))
    got = by_id(near_dups.near_duplicates(table(spark, texts), words=3, percent=85, small=6, middle=12, depth=2))
    want = plain_components(texts, 3, 85)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (i == want[i][1]) for i in got)
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (7, "a b c"), (7, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dups.near_duplicates(odd, 3, 85).collect()) == [
        ("3", "3", True), ("7", "3", False), ("7", "7", True), ("None", "None", True), ("None", "None", True)]
    assert near_dups.near_duplicates(table(spark, []), 3, 85).count() == 0


def test_sentencepiece(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS + ["a▁b  ▁", "\x00ﬁ①𝕏日本語", "</s><s> <0x41>", "x" * 33 + "𝕏é" * 40] + ["".join(rng.choice(list("ab é\n▁ 𝕏tion.,the日"), rng.integers(0, 60))) for _ in range(300)]
    got = by_id(pieces.encode(table(spark, texts), MODEL))
    library = pieces.Vocabulary(MODEL).library
    digests = by_id(pieces.encode_digests(table(spark, texts), MODEL))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == library.decode(ids), t
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_secrets(spark):
    docs = table(spark, TEXTS)
    net = secrets.fit(docs)
    got = by_id(secrets.report(docs, net))
    for i, t in enumerate(TEXTS):
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(secrets.BASE) for m in p.finditer(t or "") if len(m[g]) >= n)
        said = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(filter(None, got[i].spans.split(","))), t
    clean = by_id(secrets.redacted(docs, net))
    assert clean[0].text is None and clean[4].text == "One" and "abcdefghijkl" not in clean[15].text and clean[15].n_chars == len(clean[15].text)
    fresh = secrets.made_findings(["some plain words of a text"], 400, seed=99)
    p = secrets.probabilities(net, np.array([f[0] for f in fresh]))
    assert ((p >= net.threshold) == np.array([f[1] for f in fresh], bool)).mean() > 0.85


def test_secrets_that_overlap_or_lack_digits(spark):
    key = "qWeRtYuIoPaSdFgHjKlZxCvB"
    cases = [("see https://bob:correct-horse@host/x", "bob:correct-horse"), ("key sk_live_0123456789abcdef01234567-more end", "sk_live_0123456789abcdef01234567-more"),
             ("at db://user-0123456789abcdef0123:password@host", "user-0123456789abcdef0123:password"), (f"the {key} is", key),
             ("at db://a-very-long-user-name-of-a-service:pass@host", "a-very-long-user-name-of-a-service:pass"), (f"see ftp://me:{'aB3' * 40}@host", "me:" + "aB3" * 40),
             ("----------------BEGIN RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----")]
    for text, secret in cases:
        assert (text.index(secret), text.index(secret) + len(secret)) in secrets.candidates(text, secrets.base_spans(text)), text
    docs = table(spark, TEXTS + [text for text, _ in cases])
    net = secrets.fit(docs)
    clean = by_id(secrets.redacted(docs, net))
    for i, (text, secret) in enumerate(cases):
        assert secret.split(":")[-1] not in clean[len(TEXTS) + i].text and secrets.base_spans(text) == [s for s in secrets.scan_text(text, net) if s[2] < 3], text
    odd = "ghp_" + "aB3d" * 9 + " https://bob:correct-horse-battery-staple@host some-plain-words-with-dashes"
    assert [odd[a:b] for a, b in secrets.harmless(odd, secrets.candidates(odd, []), [])] == ["some-plain-words-with-dashes"]


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, many, many, many cookies.</div>
    <article><h1>Head&amp;line</h1><p>First  paragraph, long enough,\n to count as <b>text, really it is.<br>Next line of it, and more, and more.<p>Second &eacute; one, which is long, too, as it goes on.</p>
    <div class="ad">Buy now, buy here, buy everything, today</div><form>Mail <input></form></article><aside>Other</aside><section id="comments"><p>Nice post, thanks, I liked it, a lot, really.</p></section><footer>(c)</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (4, "u", "plain &lt;text&gt;", 4), (None, "u", "<p>" * 3000 + "deep", 5)], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert got[1].text == "Head&line First paragraph, long enough, to count as text, really it is. Next line of it, and more, and more. Second é one, which is long, too, as it goes on."
    assert got[2].text == got[3].text == "" and got[4].text == "plain <text>" and got[None].text == "deep" and got[1].n_chars == len(got[1].text)
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        inner = r.html[r.html.index("<article>"):r.html.index("</article>")]
        blocks = (" ".join(html_text.html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|div|article)[^>]*>", inner))
        assert html_text.extract(r.html) == " ".join(filter(None, blocks))


def test_html_keeps_all_of_a_nested_article():
    body = "".join(f"<p>Paragraph {k} of it, long enough, to count, as text, {'and more, ' * 12}end.</p>" for k in range(4))
    inner = f"<h1>T</h1><p>Lead.</p><div>{body}</div><h2 id=search>Two</h2><ul><li>One</li></ul><section id=related-work><p class=alert>Short.</p></section><p>End note.</p>"
    want = " ".join(re.sub("<[^>]*>", " ", inner).split())
    menu = "<nav>Home</nav><div class=sidebar>Side</div>"
    for page in (f"<article>{inner}</article>", f"<main>{menu}<div>{inner}</div></main>", f"<main>Other<article>{inner}{menu}</article></main>", f"<body>{menu}<div>{inner}<div id=comments>Nice</div></div><div>Far</div></body>"):
        assert html_text.extract(page) == want, page


def held_out(spark, df, label):
    rows = df.where("held_out").join(spark.read.parquet(f"{oracle.DATA}/sf0.1/labels.parquet"), "doc_id").collect()
    y, p = np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])
    return p[y == 1].mean(), 1 - p[y == 0].mean()


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{oracle.DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found, clean = held_out(spark, toxicity.toxicity(docs, labels), "toxic")
    assert found > 0.5 and clean > 0.97  # from 270 labelled toxic texts in four languages
    good, bad = held_out(spark, quality.quality(docs, labels), "quality")
    assert good > 0.97 and bad > 0.95


def test_toxic_words_of_every_language_are_found(spark):
    docs, labels = (spark.read.parquet(f"{oracle.DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    found = lambda y, *langs: np.mean([r.predicted for r in rows if r.toxic == y and (not langs or r.lang in langs)])
    assert found(1) > 0.75 and found(0) < 0.03
    assert found(1, "en") > 0.75 and found(1, "de") > 0.6 and found(1, "fr") > 0.6 and found(1, "es") > 0.3  # 82, 20, 30 and 12 texts


def test_classifiers_on_odd_rows(spark):
    docs, none = table(spark, TEXTS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (toxicity.toxicity(docs, none), quality.quality(docs, none)):
        rows = df.collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    model = toxicity.train(["you are an idiot today"] * 8 + ["you are a friend today"] * 8, np.array([1.0] * 8 + [0.0] * 8))
    flat = lambda t: toxicity.logits(model, *toxicity._flat([t]))[0]
    assert flat("an idiiot") > flat("a friend") and flat("idiots") > flat("friendly")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(8, 16))[rng.integers(0, 8, 1500)]
    v[700:760] = v[0]
    rows = [(i, x.tolist(), 1.0) for i, x in enumerate(v)] + [(2000, None, 1.0), (2050, [0.0] * 16, 1.0), (2100, [float("nan")] + [1.0] * 15, 1.0), (None, [1.0] * 16, 1.0), (3000, [1.0, 2.0], 1.0)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), block_rows=400, query_rows=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 1500, 50))
    unit, hit = v / np.linalg.norm(v, axis=1)[:, None], 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        hit += len({x[0] for x in found.values()} & set(best.tolist()))
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(s[i] - c) < 1e-12 for i, c in found.values())
    assert [got[0][k][0] for k in range(1, 6)] == [700, 701, 702, 703, 704] and hit >= 0.9 * 5 * len(got)


def test_token_counts(spark, tmp_path):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = by_id(token_files.count_documents(table(spark, TEXTS), ranks, public_tokenizers.PATTERN, 50256))
    table_ = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    rng = np.random.default_rng(3)
    sizes = {}
    for name in ("one", "two", "open", "empty"):
        lengths = rng.integers(0, 40, 50).tolist() + ([700] if name == "one" else [])
        flat = np.concatenate([np.append(rng.integers(0, 100, n), 500) for n in lengths])
        flat = {"open": np.append(flat, [1, 2, 3]), "empty": flat[:0]}.get(name, flat)
        sizes[name] = {"open": [*lengths, 3], "empty": []}.get(name, lengths)
        flat.astype("<u2").tofile(tmp_path / name)
    counts = {}
    for r in token_files.token_counts(token_files.number(token_files.scan(token_files.read_files(spark, f"file://{tmp_path}", block_tokens=16), 500))).collect():
        counts.setdefault(r.file.rsplit("/", 1)[1], {})[r.doc_no] = (r.n_tokens, r.closed)
    for name, want in sizes.items():
        found = counts.get(name, {})
        assert [found[k][0] for k in range(len(found))] == want and all(c for k, (_, c) in found.items() if name != "open" or k < 50)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema) if name != "near_duplicates" else stage(spark, docs, SF)
        rows = docs.collect()
        if name == "near_duplicates":
            want = plain_components([r.text for r in before], 5, 80)
            assert sorted(r.doc_id for r in rows) == sorted(before[i].doc_id for i, (_, c) in enumerate(want) if before[c].doc_id == min(before[k].doc_id for k, (_, d) in enumerate(want) if d == c) and before[i].doc_id == min(before[k].doc_id for k, (_, d) in enumerate(want) if d == c))
        elif name == "decontamination":
            grams = {tuple(w[k:k + 10]) for w in (words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) for k in range(len(w) - 9)}
            assert {r.doc_id for r in rows} == {r.doc_id for r in before if not any(tuple(w[k:k + 10]) in grams for w in [words(r.text)] for k in range(len(w) - 9))}
        elif name == "secrets":
            assert len(rows) == len(before) and not any(secrets.base_spans(r.text) for r in rows)
        elif name == "tokens":
            assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and len(rows) == len(before)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
