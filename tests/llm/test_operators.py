"""Operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import io
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftline.llm import components, jaccard, licenses, media, mixing, packing, quality, queries, repetition, token_counts, toxicity, url_filters

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "size long, score double, length long, n int, first string, one long, posting string, k int, t string, _key int, rule string"
LONG = "lorem ipsum dolor " * 20_000


def base_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        rows.append((i, " ".join(words), "en", f"s{i % 4}" if i % 9 else None))
    rows += [(100 + i, " ".join(WORD.findall(rows[i][1])[:-1] + ["Zz"]), "en", "s0") for i in range(20)]
    rows += [(200 + i, rows[i][1].upper(), None, "s1") for i in range(10)]
    rows += [(300, None, "en", "s2"), (301, "", "en", "s2"), (302, " \n\t ", None, None), (303, LONG, "en", "s3"), (304, "one", "en", "s3"), (305, "one", "en", "s3"), (306, "Größe ✓ #$ | #\nline a\nline a\n\nline a", "de", "s0"), (None, "null key text here now", "en", "s0"), (5, rows[5][1], "en", "s1"), (5, rows[5][1], "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return base_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = (1, 0.5, 2, 3, "x", 4, "p", 5, "t", 6, "r")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts(docs, rows, empty):
    library = Tokenizer.from_file(queries.vocabulary())
    expected = Counter((k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t, *_ in rows)
    out = token_counts.token_counts(docs, queries.vocabulary())
    assert Counter(tuple(r) for r in out.collect()) == expected
    assert token_counts.token_counts(empty, queries.vocabulary()).columns == out.columns


def test_packing(docs, rows, empty):
    library = Tokenizer.from_file(queries.vocabulary())
    out = [r.asDict() for r in packing.pack_documents(docs, queries.vocabulary()).collect()]
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t, *_ in rows}
    total = sum(len([*library.encode(t or "", add_special_tokens=False).ids, 2]) for _, t, *_ in rows)
    assert sum(r["length"] for r in out) == total
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-total // 1024) + 2
    assert packing.pack_documents(empty, queries.vocabulary()).count() == 0


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(100, 3, 110, 10), packing.Capacity(100, 100, 10_000, 1, score="dot"), packing.Capacity(50, 2, 40, 8, (1, 1, 1))])
def test_plan_holds_every_capacity(capacity):
    rng = random.Random(7)
    most = max(x for x in range(1, capacity.tokens + 1) if capacity.cost(x) <= capacity.attention)
    counts = Counter(rng.randint(1, most) for _ in range(3000)) + Counter({1: 500})
    bins = {}
    for length, rank, each, first, offset in packing.plan(dict(counts), capacity).tolist():
        bins.setdefault(length, []).append((rank, each, first, offset))
    held, begins = {}, {}
    for length, parts in bins.items():
        for i, (rank, each, first, offset) in enumerate(parts):
            end = parts[i + 1][0] if i + 1 < len(parts) else counts[length]
            for r in range(rank, end):
                s = first + (r - rank) // each
                held.setdefault(s, []).append(length)
                begins.setdefault(s, []).append((offset + (r - rank) % each * length, length))
    assert sum(map(len, held.values())) == sum(counts.values())
    for s, lengths in held.items():
        assert sum(lengths) <= capacity.tokens and len(lengths) <= capacity.documents and sum(map(capacity.cost, lengths)) <= capacity.attention
        at = 0
        for offset, length in sorted(begins[s]):
            assert offset == at
            at += length


def test_repetition(docs, rows, empty):
    out = {(r["doc_id"], r["n_words"]): r for r in repetition.repetition_rules(docs).collect()}
    for k, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = out[k, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        inside_shares = {}
        for n in repetition.COVERAGE:
            before, covered = set(), set()
            for i in range(len(w) - n + 1):
                gram = tuple(w[i : i + n])
                if gram in before:
                    covered |= set(range(i, i + n))
                before.add(gram)
            inside_shares[n] = sum(len(w[i]) for i in covered) / max(1, sum(map(len, w)))
            assert abs(r[f"coverage_{n}"] - inside_shares[n]) < 1e-9
        seen, inside_lines = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                inside_lines += sum(map(len, WORD.findall(line))) if line in seen else 0
                seen.add(line)
        share = inside_lines / max(1, sum(map(len, w)))
        assert abs(r["line_coverage"] - share) < 1e-9
        assert r["kept"] == (not r["base_failed"] and share <= repetition.LINE_COVERAGE and all(inside_shares[n] <= m for n, m in repetition.COVERAGE.items()))
    assert repetition.repetition_rules(empty).count() == 0


def shingles(t, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block, common, pivots", [(250_000, 20, 8), (60, 20, 8), (60, 20, 1), (250_000, 3, 8)])
def test_jaccard(docs, rows, empty, monkeypatch, block, common, pivots):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)
    monkeypatch.setattr(jaccard, "COMMON_LEAST", common)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(components, "FINISH", 0 if pivots == 1 else 1_000_000)
    keyed = [(k, shingles(t, 4)) for k, t, *_ in rows if k is not None]
    up = {k: k for k, _ in keyed}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(keyed):
        for b, y in keyed[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    expected = Counter((k, len(shingles(t, 4)), None if k is None else root(k)) for k, t, *_ in rows)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs, n=4, percent=85).collect()) == expected
    assert jaccard.jaccard_components(empty, n=4, percent=85).count() == 0
    if block > 60:
        out = jaccard.one_of_each(docs, n=4, percent=85)
        assert out.columns == docs.columns
        assert Counter(r["doc_id"] for r in out.collect()) == Counter({root(k) for k in up} | {None})
        assert jaccard.one_of_each(empty, n=4, percent=85).count() == 0


def test_keys_with_several_texts(spark):
    """Rows, not keys, are copies of each other: a row stays if another text of its key goes."""
    a, b, c = ("x%d " * 30 % tuple(range(k, k + 30)) for k in (0, 100, 200))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, b), (4, None), (4, None), (None, c), (5, ""), (6, a)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    assert kept == Counter([(1, a), (2, b), (3, c), (4, None), (4, None), (None, c), (5, "")])


def test_large_groups_of_many_blocks(spark, monkeypatch):
    """Chains of near copies and odd ones among a large group, cut into many blocks: no link between blocks is lost."""
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 400)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    for i in range(60):  # a chain that drifts away from the base
        base[i] = f"c{i}"
        rows.append((1000 - i, " ".join(base)))
    rng.shuffle(rows)
    sets = [(k, shingles(t, 5)) for k, t in rows]
    up = {k: k for k, _ in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    assert 5 < len({root(k) for k in up}) < 150
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == {k: root(k) for k in up}


def test_media(docs, rows, empty):
    out = {r["doc_id"]: r for r in media.texts_as_media(docs, keep_media=True).collect()}
    for k, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.decode(bytes(r["media"])).tobytes() == payload and hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        assert np.load(io.BytesIO(bytes(r["tile"]))).shape == (16, 16)
    assert media.texts_as_media(empty).count() == 0


def test_image_formats(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (37, 53), dtype=np.uint8), rng.integers(0, 256, (20, 31, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_pgm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P2\n# note\n2 1\n255\n7 9\n") == [[7, 9]]).all()
    assert (media.decode(b"P1\n2 1\n1 0\n") == [[0, 255]]).all()
    assert (media.decode(b"P4\n9 1\n\x80\x00") == [[0] + [255] * 8]).all()
    exact = media.area_resize(grey.astype(float), 5, 7)
    fine = np.repeat(np.repeat(grey, 5, 0), 7, 1).reshape(5, 37, 7, 53).mean((1, 3))
    assert np.allclose(exact, fine)
    rows = spark.createDataFrame([(1, bytearray(media.encode_bmp(colour))), (2, None), (3, bytearray(b"P5 x"))], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in media.image_features(rows).collect()}
    assert (out[1]["height"], out[1]["width"], len(out[1]["feature"])) == (20, 31, 16) and out[2]["feature"] is None and out[3]["tile"] is None


def test_targets_stop_at_the_cap_and_share_the_rest():
    out = mixing.targets({"a": 100, "b": 1000, "c": 1000, None: 50})
    assert out["a"] == 200 and out[None] == 100 and abs(sum(out.values()) - 1.5 * 2150) < 1e-6
    assert mixing.targets({}) == {}


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, rows_a_group=10).collect()
    sizes = Counter((k, len(WORD.findall(t or "")), s) for k, t, _, s in rows)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in out) == sizes
    taken, target, longest = Counter(), {}, Counter()
    for r in out:
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= max(60, 0.5 * longest[s])
    assert sorted(map(str, mixing.mix(docs, rows_a_group=10).collect())) == sorted(map(str, out))
    assert mixing.mix(empty).count() == 0
    again = mixing.mixed_documents(docs, rows_a_group=10)
    assert again.columns == docs.columns
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({k: n for k, n in Counter({k: sum(r["copies"] for r in out if r["doc_id"] == k) for k in {r["doc_id"] for r in out}}).items() if n})


def test_url_parts_and_rules(spark):
    pages = [
        (1, "https://A.Example.com/en/1?x#y"), (2, "http://www.example.com/en/2"), (3, "http://x.net/es/q"), (4, "http://x.net/esx"), (5, None), (6, "no scheme/here"),
        (7, "http://example.org?a://b/c"), (8, "http://Exaçmple.ORG#f"), (None, "http://badexample.com/en/"), (9, "ftp://net/fr/"), (10, "http://m.com"), (10, "http://m.com"),
    ]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, host string, n int")
    out = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_verdicts(df).collect())
    expected = Counter([
        (1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/2", "www.example.com/en/", "allow"), (3, "x.net", "/es/q", "net/es/", "block"), (4, "x.net", "/esx", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "example.org", "", None, "allow"), (8, "exaçmple.org", "", None, "allow"), (None, "badexample.com", "/en/", "com/", "allow"), (9, "net", "/fr/", "net/fr/", "block"),
    ])
    expected[(10, "m.com", "", None, "allow")] = 2
    assert out == expected
    assert url_filters.url_verdicts(df.limit(0)).count() == 0


def test_labelled_templates_are_rejected(spark):
    rows = [(i, f"http://h.org/spam/{i}/x{i}.html", "block" if i % 10 else None) for i in range(60)] + [(100 + i, f"http://h.org/news/{i}", "allow" if i % 3 else None) for i in range(60)]
    rows += [(500 + i, f"http://h.org/tag/{chr(97 + i % 26)}{chr(97 + i // 26)}z", None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    out = {r["page_id"]: r for r in url_filters.url_verdicts(df, rules=[], label="label").collect()}
    assert {out[i]["verdict"] for i in range(60)} == {"block"} and {out[100 + i]["verdict"] for i in range(60)} == {"allow"}
    assert {out[500 + i]["template"] for i in range(40)} == {"/tag/*"}


def test_few_blocked_urls_do_not_block_a_wildcard(spark):
    rare = [f"http://big.net/{chr(97 + i // 26)}{chr(97 + i % 26)}x/p" for i in range(100)]
    rows = [(i, u, None) for i, u in enumerate(rare)] + [(200, "http://big.net/es/a", None), (201, "http://big.net/fr/b", None)]
    rows += [(300 + i, f"http://c.org/{chr(97 + i // 26)}{chr(97 + i % 26)}y/p", None) for i in range(300)] + [(700 + i, "http://c.org/spam/p", "block" if i < 10 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    out = {r["page_id"]: r for r in url_filters.url_verdicts(df, label="label").collect()}
    assert {out[i]["verdict"] for i in range(100)} == {"allow"} and {out[i]["verdict"] for i in (200, 201)} == {"block"}
    assert {out[300 + i]["verdict"] for i in range(300)} == {"allow"}
    assert {(out[700 + i]["verdict"], out[700 + i]["template"]) for i in range(12)} == {("block", "/spam/p")}


def test_licenses(spark, docs, rows, empty):
    texts = ["River story.\n\nLicensed under the Apache License, Version 2.0.\nEnd", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "the general public may use the free city map", None, "", "All rights reserved."]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, _found int, family string")
    out = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert [out[i]["family"] for i in range(8)] == ["Apache-2.0", "MIT", "GPL", "CC", None, None, None, "Proprietary"]
    assert out[0]["confirmed"] and out[0]["n_paragraphs"] == 2 and out[5]["n_paragraphs"] == 0 and not out[4]["confirmed"]
    m = licenses.model()
    for i in (1, 2, 3, 7):  # one paragraph each: the plan computes what the model does
        assert abs(out[i]["probability"] - max(m.probabilities(licenses._grams(texts[i])))) < 1e-9
    assert licenses.license_scan(docs).count() == len(rows) and licenses.license_scan(empty).count() == 0


def test_wrapped_notices_are_read_whole(spark):
    rows, expected = [], {}
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            for width in (18, 40, 72, 1000):
                for mark in ("", "# ", " * "):
                    wrapped = textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False)
                    rows.append((len(rows), "River house.\n" + "\n".join(mark + line for line in wrapped) + "\nWater people.\n\nEnd"))
                    expected[rows[-1][0]] = family
    changed = licenses.NOTICES["MIT"][2].replace("obtaining a copy", "obtaining one copy")  # the changed word next to a break
    rows += [(-1, changed.replace("one copy", "one\ncopy")), (-2, changed.replace("one copy", "\none copy")), (-3, "Released under the MIT License.\nLicensed under GPL v3 or later.")]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (r["family"], r["n_license"], r["confirmed"], r["similarity"]) for k, r in out.items() if k >= 0} == {k: (f, 1, True, 1.0) for k, f in expected.items()}
    assert [(out[k]["family"], out[k]["n_license"], out[k]["confirmed"]) for k in (-1, -2)] == [("MIT", 1, True)] * 2
    assert out[-3]["n_license"] == 2 and out[-3]["families"] == ["GPL", "MIT"]


def test_license_gate_loses_nothing():
    m = licenses.model()
    cues = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, m.cue_words())) + r")(?![a-z0-9])")
    for family, notices in licenses.NOTICES.items():
        for n in notices:
            p = m.probabilities(licenses._grams(n))
            assert m.families[p.index(max(p))] == family and cues.search(n)
    rng = random.Random(4)
    for _ in range(300):
        t = " ".join(rng.choices(licenses._FILLER + sorted(licenses._PLAIN), k=rng.randint(1, 60)))
        if not cues.search(t):
            p = m.probabilities(licenses._grams(t))
            assert p.index(max(p)) == len(p) - 1


def test_native_license_plan_has_no_python(spark, sf):
    plan = licenses.license_scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_classifiers_take_every_row(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (400, None, None)], "doc_id long, quality int, toxic int")
    model = queries.toxicity_model(docs, labels)
    out = toxicity.scores(docs, model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(k for k, *_ in rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scores(empty, model).count() == 0
    nothing = queries.toxicity_model(empty, labels)
    assert {r["score"] for r in toxicity.scores(docs, nothing).collect()} == {0.0}
    good = queries.quality_model(docs, labels)
    out = quality.scores(docs, good).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(k for k, *_ in rows) and all(0 <= r["score"] <= 1 for r in out)
    assert queries.quality_model(empty, labels) is None and {r["score"] for r in quality.scores(docs, None).collect()} == {0.5}


def test_filters_pass_whole_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    for kept, scored, passes in (
        (toxicity.below(docs, m := queries.toxicity_model(docs, labels), 0.5), toxicity.scores(docs, m), lambda s: s < 0.5),
        (quality.at_least(docs, m := queries.quality_model(docs, labels), 0.3), quality.scores(docs, m), lambda s: s >= 0.3),
    ):
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in scored.collect() if passes(r["score"]))


def test_filters_and_mixes_of_nothing(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    for out in (toxicity.below(empty, queries.toxicity_model(docs, labels), 0.5), quality.at_least(empty, queries.quality_model(docs, labels), 0.3), mixing.mixed_documents(empty)):
        assert out.columns == docs.columns and out.count() == 0
    images = spark.createDataFrame([], "doc_id long, media binary")
    assert media.image_features(images).count() == 0


def test_licenses_of_awkward_texts(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "river water house " * 50_000 + "\n\n" + notice), (5, notice + "\n" + notice), (5, notice + "\n" + notice), (None, notice), (6, notice + "\nReleased under the BSD 3-Clause License."), (7, "Distributed under the terms of the Sleepycat License.")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, _best int, similarity string")
    out = licenses.license_scan(df).collect()
    by = {r["doc_id"]: r for r in out}
    assert Counter(r["doc_id"] for r in out) == Counter(k for k, _ in rows)
    assert [(by[k]["n_paragraphs"], by[k]["n_license"], by[k]["family"]) for k in (1, 2, 3, 4, 5, None)] == [(0, 0, None)] * 3 + [(2, 1, "MIT"), (1, 2, "MIT"), (1, 1, "MIT")]
    assert by[6]["n_license"] == 2 and by[6]["families"] == ["BSD", "MIT"]
    assert by[7]["family"] == licenses.UNKNOWN and by[7]["n_unknown"] == 1 and by[7]["probability"] is None and not by[7]["confirmed"]


def test_pipeline_on_awkward_documents(spark, tmp_path, sf):
    import corpus_pipeline

    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "", None, None, 0), (None, "a text without a key " * 5, "en", "src2", 9)], source.schema)
    again = source.limit(20)
    folder = str(tmp_path)
    source.union(odd).union(again).withColumnsRenamed({"lang": "length", "n_chars": "row"}).withColumnsRenamed({"row": "size"}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(0 < r["length"] <= 1024 for r in out)
    nothing = str(tmp_path / "none")
    source.limit(0).write.parquet(f"{nothing}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for name, label, least in (("op1_toxicity", "toxic", 0.95), ("op2_quality_classifier", "quality", 0.95)):
        held = [(r["predicted"], labels[r["doc_id"]][label]) for r in queries.queries()[name](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
        assert len(held) > 300 and sum(p == y for p, y in held) >= least * len(held), name


def test_pipeline_stages_keep_the_contract(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        docs = docs.checkpoint()
        if i < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.agg({"length": "max"}).first()[0] <= 1024
