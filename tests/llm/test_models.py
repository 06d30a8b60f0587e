"""Language ID, toxicity, personal data, licenses, WARC and neighbours."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basaltine.llm import ann, langid, licenses, pii, toxicity, warc
from basaltine.llm.common import shared_dir

from .conftest import prose


# ---------------------------------------------------------------- language ID


def test_langid(spark, odd, empty):
    a, b = "the house and the garden of the king", "das haus und der garten des königs"
    train = spark.createDataFrame([(i, " ".join([a, b][i % 2].split()[i % 5 :]), ["en", "de"][i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    probe = spark.createDataFrame([(1, "the gardens"), (2, "GARTEN"), (3, "haus und königs"), (4, None), (5, "12 —"), (6, "qqqq"), (7, "königlich hausherr")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(probe, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "de", "und", "und"] and got[7][0] == "de"
    assert got[4][1] == got[5][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    rows = langid.identify(odd, model, tuple(odd.columns)).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.lang_pred for r in rows}[11] == "und"
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(probe, none).collect()} == {"und"}


def test_grams():
    h, owner = langid.grams(["ab", "c"], 2)
    assert owner.tolist() == [0, 0, 0, 1, 1] and len(set(h.tolist())) == 5
    assert langid.grams(["ab"], 1)[1].tolist() == [0, 0] and langid.grams(["a"], 5)[1].tolist() == []


def test_rare_languages_are_learned(spark):
    rows = [(i, prose(i, 8) + " und", "aa") for i in range(3000)] + [(4000 + i, f"zyxwv qponm{i} ", "bb") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40, least=10)
    probe = spark.createDataFrame([(1, "zyxwv"), (2, prose(5, 9))], "doc_id long, text string")
    assert model.languages == ["aa", "bb"] and [r.lang_pred for r in sorted(langid.identify(probe, model).collect())] == ["bb", "aa"]


def test_scores_against_plain_ones(spark):
    """Scores as the docstring has them, from plain counts of whole words and n-grams."""
    texts = [("de", "haus und hof"), ("de", "haus im hof"), ("en", "house and yard"), ("en", "a house"), ("fr", "la maison et la cour")]
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string"))
    langs = ["de", "en", "fr"]

    def parts(word, order):
        w = f" {word} "
        return [g for g in (w[i : i + order] for i in range(len(w) - order + 1)) if g != " "] if order else [word]

    count = {(o, x): {} for o in (0, *langid.ORDERS) for x in langs}
    for lang, t in texts:
        for w in t.split():
            for o in (0, *langid.ORDERS):
                for g in parts(w, o):
                    count[o, lang][g] = count[o, lang].get(g, 0) + 1

    def score(word):
        for o in (0, *langid.ORDERS):
            total = {x: max(1, sum(count[o, x].values())) for x in langs}
            known = [g for g in parts(word, o) if any(g in count[o, x] for x in langs)]
            if known:
                low = np.log10(0.5 / max(total.values()))
                return [np.mean([np.log10(count[o, x][g] / total[x]) if g in count[o, x] else low for g in known]) for x in langs]
        return None

    for text in ("haus", "hofhaus", "la yard", "maisons und houses q", "a"):
        seen = langid._Seen(*langid.utf8(pa.array([text])))
        level, base, some = model.word_scores(seen)
        for k, (a, b) in enumerate(zip(level.first[:-1], level.first[1:], strict=True)):
            want = score(text.split()[int(np.flatnonzero(seen.word == k)[0])])
            assert some[k] == (want is not None)
            if want:
                got = np.full(3, base[k])
                got[level.lang[a:b]] += level.gain[a:b]
                assert np.allclose(got, want, atol=1e-5)


def test_langid_query(spark, sf):
    rows = langid.op4_word_backoff_langid(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


# ---------------------------------------------------------------- toxicity


def test_chain(spark, odd, empty):
    rows = [(i, prose(i, 50) + (" nasty vile" if i % 4 == 0 else "") + (" junkword" if i % 3 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(300)] + [(301, None, 1)], "doc_id long, junk int, toxic int")
    chain = toxicity.fit(docs, labels, ("junk", "toxic"))
    got = {r.doc_id: r for r in toxicity.classify(docs, chain).collect()}
    assert all((got[i].p_toxic >= chain.thresholds[1]) == (i % 4 == 0) and (got[i].p_junk > 0.5) == (i % 3 == 0) for i in range(300, 400))
    assert len(toxicity.classify(odd, chain).collect()) == odd.count() and toxicity.classify(empty, chain).count() == 0
    none = toxicity.fit(docs, labels.limit(0), ("junk", "toxic"))
    assert {round(r.p_toxic, 3) for r in toxicity.classify(docs, none).collect()} == {0.5}


def test_chain_uses_earlier_categories():
    """The second label is the first one's; its own words are noise."""
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    ids = np.concatenate([np.array([1 if v else 2, 100 + rng.integers(0, 50)]) for v in y])
    chain = toxicity.fit_chain(ids, np.arange(0, 2 * n + 1, 2), np.stack([y, y], 1), np.arange(n) % 5, ("a", "b"))
    assert chain.models[1].chain[0] > 0


# ---------------------------------------------------------------- personal data

_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(_PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0
            if [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15][k]:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0129()%é\n", max_size=60) | st.lists(st.sampled_from(["a@b.co", "@", "1.2.3.4", "256.1.1.1", ".5", "4111111111111111", "+1 (555) 123-4567", " ", "-", "x"]), max_size=12).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000, "a" * 100_000 + "@" * 100_000, "+1" + "." * 200_000, "1." * 100_000):
        pii.base_spans(text)


def pii_rows(n):
    kinds = [
        lambda i: f"call +1 (555) 123-45{i % 90 + 10} now",
        lambda i: f"mail user{i}@mail.example.com ok",
        lambda i: f"from 10.{i % 200}.0.{i * 7 % 200} down",
        lambda i: "card " + next(c for c in (f"45{i:05d}1234567{d}0{d}" for d in range(10)) if pii._luhn(c[:16]))[:16] + " paid" if any(pii._luhn(f"45{i:05d}1234567{d}0{d}"[:16]) for d in range(10)) else "no card",
    ]
    return [(i, f"{prose(i, 12)} {kinds[i % 4](i)} {prose(i + 1, 12)} version {i % 9}.0 of {i} items") for i in range(n)]


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.createDataFrame(pii_rows(400), "doc_id long, text string"))


def test_field(spark, odd, empty, field):
    text = "mail bob@mail.example.com or 10.0.0.7 version 2.0"
    ((base, spans),) = pii.all_spans([text], field)
    assert base == plain_spans(text) and set(base) <= set(spans)
    assert not any("2.0" == text[s:e] for s, e, _ in spans)
    found = pii.find(odd, field, tuple(c for c in odd.columns if c != "text"), redact=True).collect()
    assert len(found) == odd.count() and pii.find(empty, field).count() == 0
    assert pii.redacted("a b@c.de f", [(2, 8, 0)]) == "a [EMAIL] f"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.fit(none) is None and pii.all_spans(["1.2.3.4"], None)[0][0] == [(0, 7, 1)]


@pytest.mark.parametrize("intact, repeat", [("bob.s7@mail.example.com", "bob.s7(at)mail.example.com"), ("10.20.0.7", "10.20.0.x"), ("4524132264652876", "4524_1322_6465_2876"), ("4524132264652876", "452413x264652876")])
def test_broken_repeats_are_found_through_their_skip_link_alone(field, intact, repeat):
    text = f"{prose(3, 20)} {intact} {prose(4, 200)} {repeat} {prose(5, 20)}"
    at = text.index(repeat)
    cut = pii.Field(field.weights, np.concatenate([field.pair[:1], np.zeros_like(field.pair[1:])]))

    def added(t, f):
        ((base, spans),) = pii.all_spans([t], f)
        return [s[:2] for s in spans if s not in base]

    assert added(text, field) == [(at, at + len(repeat))]
    assert added(text, cut) == [] and added(text.replace(intact, "word"), field) == []


def test_entities_side_by_side_are_told_apart(field):
    text = f"{prose(3, 20)} 4524132264652876 4524132264652876 {prose(4, 20)}"
    ((base, spans),) = pii.all_spans([text], field)
    assert base == [] and [(text[s:e], k) for s, e, k in spans] == [("4524132264652876 4524132264652876", 2)]


def test_skip_links_pull_labels_together():
    """A weak mention of a token is pulled to the label of its strong repeat."""
    pair = np.zeros((pii.LINKS, 5, 5))
    pair[pii.SAME] = np.eye(5) * 2 - 0.5
    field = pii.Field(np.zeros((pii.FEATURES, 5)), pair)
    field.weights[35, 1] = 4.0  # the token before has a digit
    g = pii.graph("x 12345 99.7 here and far away again 99.7 end", [])
    assert (1, 2, pii.SAME) in g.links
    (linked,), (alone,) = field.marginals([g]), pii.Field(field.weights, pair * 0).marginals([g])
    assert linked[-1, 1] > alone[-1, 1] + 0.1


def test_messages_are_exact_on_trees():
    """On a chain of three nodes beliefs are the marginals of all labellings; several graphs at once don't mix."""
    rng = np.random.default_rng(8)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(pii.LINKS, 5, 5)))
    g = pii.graph("10.0.0.7 +12 9@x", [])
    assert [x[2] for x in g.links] == [0, 0]
    u = np.array([field.weights[a].sum(0) for a in g.active])
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + field.pair[0][:, :, None] + field.pair[0][None])
    joint /= joint.sum()
    one, two = field.marginals([g, g], turns=60)
    assert np.allclose(one, np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]), atol=1e-4) and np.allclose(one, two, atol=1e-5)


def test_weights_are_learned_together():
    """Gradients of the fitted field: expected and real counts of links agree on what it was fitted on."""
    rows = [t for _, t in pii_rows(120)]
    found = [pii.base_spans(t) for t in rows]
    pool = [(t[s:e], k) for t, b in zip(rows, found, strict=True) for s, e, k in b]
    graphs = [x for i, (t, b) in enumerate(zip(rows, found, strict=True)) for x in pii.noised(t, b, pool, np.random.default_rng(i))]
    f = pii.Field.fit(graphs)
    s = pii.Sample.of(graphs)
    p = np.concatenate(f.marginals([g for g, _ in graphs]))
    assert (p.argmax(1) == s.label).mean() > 0.93
    assert abs(f.pair[pii.CHARACTERS]).max() > 0.5 and np.allclose(f.pair[1:], f.pair[1:].transpose(0, 2, 1))


def test_pii_query(spark, sf):
    """All columns against the patterns written out plainly; further spans only where no base span is touched."""
    names = ["email", "ip", "card", "phone"]
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op7_skip_chain_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        base = plain_spans(text[r.doc_id])
        listed = [f"{names[k]}:{s}:{e}" for s, e, k in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(listed) <= set(r.spans.split(",")) or not listed
        order = [(int(s), names.index(k)) for k, s, _ in spans]
        assert order == sorted(order)
        for k, s, e in spans:
            if f"{k}:{s}:{e}" not in listed:
                assert not any(a < int(e) and int(s) < b for a, b, _ in base)


# ---------------------------------------------------------------- licenses


def test_licenses(spark, odd, empty):
    noise = prose(9, 40)
    apache = licenses.TEMPLATES["Apache-2.0:header"]
    broken = apache.replace("governing", "ruling").replace("either express", "expressed")
    rows = [(1, f"{noise} Released under the MIT License. {noise}"), (2, f"{noise}\n{broken}\n{noise}"), (3, noise), (4, f"Licensed under CC BY-NC 4.0. {noise} licensed under cc by-nc 4.0"), (5, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.license for r in by[1]] == ["MIT:line"] and [r.license for r in by[2]] == ["Apache-2.0:header"] and set(by) == {1, 2, 4}
    assert by[1][0].coverage == 1 and 0.9 < by[2][0].coverage < 1 and len(by[4]) == 2
    assert rows[0][1].encode()[by[1][0].start : by[1][0].end].decode() == "Released under the MIT License"
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.Index({"x": "too short"}, 3, 3)


def test_winnowing_keeps_shared_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        run = rng.integers(0, 2**63, 5).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 2**63, 9).astype(np.uint64), run, rng.integers(0, 2**63, 7).astype(np.uint64)])
        x = licenses.fingerprints(a, np.array([0, len(a)]), 3, 3)[0]
        y = licenses.fingerprints(run, np.array([0, 5]), 3, 3)[0]
        assert set(x.tolist()) & set(y.tolist())


@pytest.mark.parametrize("name", ["MIT:line", "CC-BY-NC-4.0:line", "Apache-2.0:line", "Apache-2.0:header"])
def test_adjacent_licenses_are_all_found(name):
    index = licenses.Index(licenses.TEMPLATES, 3, 3)
    n = len(index.words[index.names.index(name)])
    for many in (1, 2, 3, 7):
        for text in (" ".join([licenses.TEMPLATES[name]] * many), prose(3, 9) + " " + " between ".join([licenses.TEMPLATES[name]] * many)):
            h, _, _, first = licenses.words(*licenses.utf8(pa.array([text])), licenses.ALNUM)
            rows = index.scan(h, first, 0.8, 8)
            assert [index.names[r[1]] for r in rows] == [name] * many and all(r[5] - r[4] == n for r in rows)


def plain_alignment(template, text):
    """Best local alignment without a band: (score, matched, begin, end); matches 2, mismatches and gaps -1."""
    best, before = (0, 0, 0, 0), [(0, 0, j) for j in range(len(text) + 1)]
    for w in template:
        row = [(0, 0, 0)]
        for j, v in enumerate(text):
            s, m, f = before[j]
            options = [(s + 2, m + 1, f if s else j) if v == w else (s - 1, m, f), (before[j + 1][0] - 1, *before[j + 1][1:]), (row[j][0] - 1, *row[j][1:])]
            top = max(options, key=lambda x: x[:2])
            row.append(top if top[0] > 0 else (0, 0, j + 1))
            if top[0] > best[0]:
                best = (*top, j + 1)
        before = row
    return best


def plain_matches(template, text, least, at=0):
    """Best alignment first, then the words left and right of it."""
    score, matched, begin, end = plain_alignment(template, text)
    if not matched or matched < least:
        return []
    return [*plain_matches(template, text[:begin], least, at), (at + begin, at + end, matched), *plain_matches(template, text[end:], least, at + end)]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_repeats_against_a_plain_aligner(data):
    """One to five occurrences with edits, next to each other or apart: the same matches as an aligner without index, band or fingerprints."""
    template = [f"t{i}" for i in range(22)]
    text = [f"n{i}" for i in range(data.draw(st.integers(0, 6)))]
    for c in range(data.draw(st.integers(1, 5))):
        copy = list(template)
        for e in range(data.draw(st.integers(0, 2))):
            at = data.draw(st.integers(4, 17))
            copy[at : at + data.draw(st.integers(0, 1))] = [f"e{c}x{e}"] * data.draw(st.integers(0, 2))
        text += copy + [f"m{c}y{i}" for i in range(data.draw(st.sampled_from([0, 0, 1, 7])))]
    index = licenses.Index({"x": " ".join(template)}, 3, 3)
    (h,) = licenses.hashed([" ".join(text)])
    got = [(r[4], r[5], r[3]) for r in index.scan(h, np.array([0, len(h)]), 0.8, 8)]
    assert got == plain_matches(template, text, 0.8 * 22)


def found_in(text: str, **options) -> list[str]:
    index = licenses.Index(options.get("templates", licenses.TEMPLATES), 3, 3)
    (h,) = licenses.hashed([text])
    return [index.names[r[1]] for r in index.scan(h, np.array([0, len(h)]), 0.8, 8)]


def test_names_and_versions_decide():
    assert "GPL-3.0:line" not in found_in("This work is licensed under the GNU General Public License, version 2.")
    assert "Apache-2.0:line" not in found_in("Licensed under the Apache License, Version 1.0.")
    assert "MIT:line" not in found_in("Released under the BSD License.")
    assert "GPL-3.0:line" not in found_in("This work is licensed under the GNU Affero General Public License, version 3.")
    assert "GPL-3.0:header" not in found_in(licenses.TEMPLATES["GPL-3.0:header"].replace("version 3", "version 2"))
    assert found_in("Licensed under the Apache License 2.0.") == ["Apache-2.0:line"]
    own = {"own": "Given under the Foo License, version 7."}
    assert found_in("Given under the Foo License, version 8.", templates=own) == [] and found_in(own["own"], templates=own) == ["own"]


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Unlicense", "CC0-1.0", "BSL-1.0", "Zlib"])
def test_whole_texts_are_found(name):
    whole = licenses.built_in()
    assert found_in(f"{prose(4, 30)} {whole[name + ':text']} {prose(5, 30)}", templates=whole) == [f"{name}:text"]


def test_every_template_is_its_own_best():
    whole = licenses.built_in()
    for name in licenses.TEMPLATES:
        assert found_in(whole[name], templates=whole) == [name]


# ---------------------------------------------------------------- WARC


def test_warc(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/\nx", "y" * 200_000), (2, "http://b/", "<p>é</p>"), (None, "http://n/", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    base = shared_dir(spark)
    index = warc.normalise(warc.write_archives(df, f"{base}/a"), f"{base}/a", f"{base}/b")
    got = sorted(warc.read_archives(index, f"{base}/b").collect(), key=lambda r: (r.page_id or 0, r.record_type))
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", 1 << 60))
    assert len(got) == len(pages)
    for r in got:
        h = {p: h or "" for p, _, h in pages}[r.page_id].encode()
        assert r.payload_bytes == len(h) and r.payload_digest == base64.b32encode(hashlib.sha1(h).digest()).decode()
        lead = first.get(h.decode(), r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))
        assert r.payload == (h if lead == r.page_id else None)
    whole = warc.write_archives(df, f"{base}/c", smallest=5)
    some = warc.read_archives(warc.normalise(whole, f"{base}/c", f"{base}/d"), f"{base}/d")
    assert {r.page_id for r in some.where("record_type = 'revisit'").collect()} == {2}
    nothing = warc.write_archives(df.limit(0), f"{base}/e")
    assert warc.read_archives(warc.normalise(nothing, f"{base}/e", f"{base}/f"), f"{base}/f").count() == 0


def test_monolithic_streams():
    raw = [warc.record(i, f"http://x/{i}", b"z" * i * 100, "D", None) for i in range(20)]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = gz.compress(b"".join(raw)) + gz.flush()
    for size in (7, 1000, 1 << 20):
        assert list(warc.records(warc.inflated(io.BytesIO(whole), size))) == raw
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[3][:-20]])))
    assert list(warc.records(warc.inflated(io.BytesIO(whole * 3), 1000))) == raw * 3
    # Cut anywhere, also at the end of a record, a stream is an error.
    gz, parts = zlib.compressobj(6, zlib.DEFLATED, 31), []
    for r in raw:
        parts.append(gz.compress(r) + gz.flush(zlib.Z_FULL_FLUSH))
    for cut in (b"".join(parts[:6]), whole[:-1], whole[: len(whole) // 2], whole[:5], whole + whole[:30]):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(io.BytesIO(cut))))
    assert list(warc.inflated(io.BytesIO(b""))) == []


def test_inflation_is_bounded():
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = gz.compress(b"a" * 50_000_000) + gz.flush()
    sizes = [len(x) for x in warc.inflated(io.BytesIO(bomb), 1 << 16)]
    assert max(sizes) <= 1 << 16 and sum(sizes) == 50_000_000


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("codes", F.lit("clash"))
    index, quantiser, dim = ann.build(df)
    assert dim == 16 and index.count() == 3000
    got = ann.search(index, quantiser, dim, index.where("vec_id % 100 = 0 or vec_id = 3")).collect()
    hit = 0
    for q in [3, *range(0, 3000, 100)]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), dist)) if i != q][:10]
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r.score == pytest.approx(dist[r.vec_id], abs=1e-12) for r in mine)
        hit += len({r.vec_id for r in mine} & set(order))
    assert hit >= 0.9 * 310 and next(r for r in got if r.query_id == 3 and r["rank"] == 1).vec_id == 7


def test_many_copies_keep_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4096, 16))
    x[rng.permutation(4096)[:1365]] = x[0]  # far more equal vectors than are reranked
    x[rng.permutation(4096)[:600], 0] *= -0.0
    ids = rng.permutation(4096)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    index, quantiser, dim = ann.build(df)
    group = sorted(int(i) for i, r in zip(ids, x, strict=True) if (r == x[0]).all())
    near = x[0] + 1e-3
    asked = [(group[0], x[0]), (group[700], x[0]), (9001, near)]
    got = ann.search(index, quantiser, dim, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in asked], "vec_id long, embedding array<double>")).collect()
    for i, _ in asked:
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [j for j in group if j != i][:10]


def test_equal_codes_are_not_cut():
    # One code for all rows, so that the lookup tables can't tell them apart.
    x = np.arange(1.0, 1001.0)[:, None] * np.ones(4)
    ids = np.random.default_rng(6).permutation(1000)
    rows = pa.record_batch([pa.array(np.zeros(1000, np.int32)), pa.array(ids), pa.array([b"\0"] * 1000, pa.binary()), pa.array(np.zeros(1000, np.float32)), pa.array(x.tolist())], ["bucket", "vec_id", "codes", "norm", "embedding"])
    near, far = ann._Bucket(rows, 1, 4).nearest(np.array([5000]), np.full((1, 4), 500.2), np.zeros((1, 1, 256), np.float32), 10, 192)
    assert near[0].tolist() == [int(ids[i - 1]) for i in (500, 501, 499, 502, 498, 503, 497, 504, 496, 505)] and abs(far[0, 0] - 0.4) < 1e-9


def exact(x, ids, q, k=10):
    with np.errstate(over="ignore"):
        dist = ann.distances(x, x[list(ids).index(q)])
    order = np.lexsort((ids, dist))
    return [(int(ids[i]), float(dist[i])) for i in order if ids[i] != q][:k]


def test_all_vectors_on_demand_is_brute_force(spark, monkeypatch):
    """Without a bound on candidates a search is exact, over several buckets, blocks of queries and held parts."""
    for name, value in (("BUCKET", 100), ("BLOCK", 7), ("HOLD", 30_000)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 8)).round(1)
    x[100:160] = x[99]
    x[200], x[201] = 1e200, -1e200
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    index, quantiser, dim = ann.build(df, books=2)
    assert index.select("bucket").distinct().count() == 7
    asked = [*range(0, 700, 50), 99, 201]
    got = ann.search(index, quantiser, dim, index.where(F.col("vec_id").isin(asked)), rerank=None).collect()
    for q in asked:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(v, s) for _, v, s in mine] == [(v, pytest.approx(s, rel=1e-12)) for v, s in exact(x, np.arange(700), q)]


def test_neighbours_query(spark, sf):
    """The query against brute force on its whole table: exact scores, and recall."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = ann.op10_additive_ann(spark, sf).collect()
    hit = 0
    asked = [int(i) for i in ids if i % 100 == 0]
    for q in asked:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        want = exact(x, ids, q)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        dist = dict(zip(ids.tolist(), ann.distances(x, x[list(ids).index(q)]).tolist(), strict=True))
        assert all(s == dist[v] for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & {v for v, _ in want})
    assert hit >= 0.9 * 10 * len(asked)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index, quantiser, dim = ann.build(df)
    got = ann.search(index, quantiser, dim, index.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    index, quantiser, dim = ann.build(df.limit(0))
    assert ann.search(index, quantiser, dim, index).count() == 0


def test_conjugate_gradients():
    rng = np.random.default_rng(3)
    m, b = rng.normal(size=(90, 60)), rng.normal(size=(60, 5))
    a = m.T @ m + 0.1 * np.eye(60)
    assert np.allclose(a @ ann.solved_near(a, b, np.zeros((60, 5)), gap=1e-9), b, atol=1e-5)


def test_beam_search_lowers_the_error():
    x = np.random.default_rng(2).normal(size=(800, 12))
    q = ann.Quantiser.fit(x, books=4, codes=16)
    error = [((x - q.decode(q.encode(x, beam))) ** 2).sum() for beam in (1, 8)]
    assert error[1] < error[0]
