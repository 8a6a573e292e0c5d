"""The training-data operators against brute force on small fixtures, edge cases included."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    chat_format, components, decontamination, licenses, line_dedup, nearest, packing, pii, quality, registry, simhash_dedup, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, dk long, h1 long, pos int"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(3, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in zip(ids, texts)], DOCS)


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i % 7] + [(100, i) for i in range(60, 90)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups([x for x in links if None not in x], {n for x in links for n in x if n is not None})
    assert got == {n: r for n, r in want.items() if n in got} and all(r == n for n, r in want.items() if n not in got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash -----------------------------------------------------------------------------------------


def test_simhash_fingerprints_and_components(spark):
    base = prose(300, 1)
    texts = [base, base, base.upper(), base + " tail", base.replace(" ", "\n", 5), prose(200, 2), "", None, "  \n", "one", "one two", prose(30_000, 3)]
    texts += [" ".join(w if k else "zz" for k, w in enumerate(base.split())) for _ in range(2)]
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs(spark, texts)).collect()}

    def plain(t):
        import xxhash

        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [plain(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    near = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert {i: r.component_id for i, r in got.items()} == groups(near, range(len(fps)))
    kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == set(groups(near, range(len(fps))).values())


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-2**62, 2**62, 40)]
    for f in fps[:40]:
        for k in range(1, 6):
            for b in rng.choice(64, k, replace=False):
                f ^= 1 << int(b)
            fps.append(f - 2**64 if f >= 2**63 else f)
    fps = sorted({(f + 2**63) % 2**64 - 2**63 for f in fps})
    got = {tuple(sorted(r)) for r in simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin((a ^ b) % 2**64).count("1") <= 3}


def test_simhash_empty_table(spark):
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0


# Line dedup --------------------------------------------------------------------------------------


def brute_lines(texts, max_bits=2, similarity=0.8):
    """Kept lines per document by all pairs."""
    import xxhash

    def norm(s):
        return re.sub(r"[\W_]+", " ", s.lower()).strip()

    places = [(d, i, norm(s)) for d, t in enumerate(texts) if t is not None for i, s in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]

    def sim(s):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in s.split()]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    sims = {p[2]: sim(p[2]) for p in places}
    links = []
    for i, p in enumerate(places):
        for q in places[:i]:
            if p[2] == q[2]:
                links.append((p[:2], q[:2]))
            elif min(len(p[2].split()), len(q[2].split())) >= 5 and bin(sims[p[2]] ^ sims[q[2]]).count("1") <= max_bits:
                a, b = p[2].split(), q[2].split()
                if distance(a, b) <= int(max(len(a), len(b)) * (1 - similarity) + 1e-9):
                    links.append((p[:2], q[:2]))
    root = groups(links, [p[:2] for p in places])
    gone = {n for n, r in root.items() if n != r}
    return [None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


@pytest.mark.parametrize("crowd", [64, 1])
def test_line_dedup(spark, crowd):
    shared, long = prose(60, 7), prose(400, 8)
    changed = [" ".join(w if j != k else "changed" for j, w in enumerate(long.split())) for k in range(6)]
    texts = [shared + "\n" + prose(20, 9), "Title\n" + shared.upper() + "!", None, "", "a b\na b", long, *changed, shared, prose(300, 10) + "\n" + prose(2000, 11)]
    out = line_dedup.duplicate_lines(docs(spark, texts), crowd=crowd).collect()
    gone = {r.doc_id: set(r.gone) for r in out}
    got = [None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in enumerate(texts)]
    assert got == brute_lines(texts)
    if crowd == 64:
        rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts), count="n_removed").collect()}
        assert [rows[i].text for i in range(len(texts))] == got
        assert rows[0].n_chars == len(got[0]) and rows[0].fp == 1 and rows[12].text == "" and rows[12].n_removed == 1


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert [r.text for r in line_dedup.dedup_lines(docs(spark, [None, ""])).orderBy("doc_id").collect()] == [None, ""]


# Decontamination ---------------------------------------------------------------------------------


def test_decontamination(spark):
    items = [prose(30, s) for s in range(20, 26)] + ["too short", None]
    swapped = " ".join(w if k % 6 else "other" for k, w in enumerate(items[1].split()))
    texts = [prose(100, 30) + " " + items[0].upper() + ". " + prose(50, 31), prose(40, 32) + " " + swapped, items[2][: len(items[2]) // 2], prose(500, 33), None, "", "too short", items[3], items[3]]
    bench = spark.createDataFrame([(i, t, 9) for i, t in enumerate(items)] + [(77, items[0].title(), 9)], "item_id long, text string, dk long")
    got = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (6, 6), (7, 3), (8, 3)}
    assert got[0, 0].matched == 30 and got[0, 0].doc_start == 100 and got[0, 0].coverage == 1.0
    assert 22 <= got[1, 1].matched <= 25
    kept = decontamination.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs(spark, texts).columns
    empty = spark.createDataFrame([], bench.schema)
    assert decontamination.overlaps(docs(spark, texts), empty).count() == 0 and decontamination.overlaps(docs(spark, []), bench).count() == 0


# Packing -----------------------------------------------------------------------------------------


def test_packing(spark):
    path = packing.tokenizer_path()
    texts = ["Hello, World! it's é 12", "", None, prose(9000, 40), prose(5, 41), prose(5, 41), "<|endoftext|> x Σας", "a\x1cb \u3000 日本語", *(prose(int(n), int(n)) for n in range(10, 900, 23))]
    rows = packing.pack(docs(spark, texts), path, block_rows=7).collect()
    whole = packing.encoder(path).whole
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in enumerate(texts)}
    assert len(rows) == sum(-(-len(x) // 4096) for x in ids.values())
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) == -(-sum(map(len, ids.values())) // 4096)
    assert packing.pack(docs(spark, []), path).count() == 0


def test_fillings_use_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6, 1.2, 5000).astype(int)))
    counts = Counter(lengths.tolist())
    plan = packing.fillings(dict(counts))
    used = Counter()
    for times, filling in plan:
        assert sum(n * k for n, k in filling.items()) <= 4096
        for n, k in filling.items():
            used[n] += k * times
    assert used == counts and sum(t for t, _ in plan) <= -(-lengths.sum() // 4096) + 2


def test_best_pair_replaces_the_smallest():
    # 60 + 30 leaves 10; 30 gives way to 25 + 15, which fill the 40 exactly.
    assert dict(packing.fillings({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0][1]) == {60: 1, 25: 1, 15: 1}


# Quality -----------------------------------------------------------------------------------------


def test_quality(spark):
    good = [prose(120, s).capitalize() + "." for s in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in prose(120, s).split()) for s in range(300, 400)]
    texts = [*good, *bad, "", None]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0) for i in range(400)] + [(None, 1), (9999, 0), (3, 1), (5, None)], "doc_id long, quality int")
    stats = quality.document_statistics(d)
    model = quality.fit(stats, labels)
    rows = {r.doc_id: r for r in quality.scores(stats, model).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == (i < 300) for i in held]) >= 0.95
    kept = quality.keep_good(d, model)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    assert quality.keep_good(docs(spark, []), model).count() == 0


def test_quality_without_labels(spark):
    stats = quality.document_statistics(docs(spark, ["a", None]))
    model = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.scores(stats, model).collect()] == [0.5, 0.5]


def test_isotonic_is_monotone_and_keeps_the_mean():
    w, p = np.array([1.0, 2, 3, 4]), np.array([1.0, 0, 3, 2])
    fit = quality._pooled(w, p)
    assert (np.diff(fit) >= 0).all() and (fit * w).sum() == pytest.approx(p.sum())


# Personal data -----------------------------------------------------------------------------------

_BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def luhn(d):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    def passes(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in _BASE for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_pii_base_spans(spark):
    texts = [
        "é mail a@b.c_d@e.f, x@y and 10.0.0.1.5 or 1.2.3.256 or 001.002.003.004", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111 4111 1111 1111 11111111",
        "call +1 (499) 555-6503. or +12 or +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", None, "", "9" * 30_000, "a" * 50_000 + "@x.y", "1 2 3 4 5 6 7 8 9 0 1 2 3", "日本 +44 20 7946 0958 日本 q@日.jp @a.b",
        "x@a.b.c.d.e@f.g", "5.5.5.5.5.5.5.5", "4 111-1111 1111 1111 1",
    ]
    for r in pii.find(docs(spark, texts)).collect():
        want = base_spans(texts[r.doc_id])
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] == want, texts[r.doc_id]
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_learns_to_add(spark):
    rng = np.random.default_rng(0)
    texts = [f"call +1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)} now" for _ in range(400)]
    texts += [f"call 1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)} now" for _ in range(2)]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts), precision=0.9).collect()}
    assert len(rows[0].base) == 1 and not rows[0].added
    assert [pii.KINDS[s.kind] for s in rows[400].added] == ["phone"]
    red = pii.find(docs(spark, texts), precision=0.9).join(docs(spark, texts).select("doc_id", "text"), "doc_id").select("doc_id", pii.redact().alias("t"))
    assert {r.t for r in red.collect()} == {"call [PHONE] now"}


# URLs --------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/en/1?x#y", "https://example.org", "x://É.COM/fr/a#b", "http://com/de/", "http://notexample.org/es/", "a://b?c/d", "http://sub.example.org/es/x", "s://h/p://q"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    rows = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [(rows[i].host, rows[i].path) for i in range(4)] == [("", ""), ("", ""), ("", ""), ("a.example.org", "/en/1")]
    assert rows[3].rule == "example.org/en/1" and rows[3].verdict == "block" and rows[4].rule is None
    assert rows[5].host == "É.com" and rows[5].rule == "com/fr/" and rows[6].rule == "com/de/" and rows[7].rule == "org/"
    assert rows[8].host == "b" and rows[9].verdict == "block" and (rows[10].host, rows[10].path) == ("h", "/p://q")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_reputation_blocks_only_with_evidence(spark):
    rows = [(f"mixed{i}.example.com", p) for i in range(12) for p in ("de", "fr") * 5]
    rows += [("bad.example.com", "de")] * 60 + [("good.example.com", "fr")] * 60 + [("thin.example.com", "de")] + [("bad.example.com", "en"), ("good.example.com", "en"), ("thin.example.com", "en"), ("new.example.net", "en")]
    pages = spark.createDataFrame([(i, f"http://{h}/{p}/x") for i, (h, p) in enumerate(rows)], "page_id long, url string")
    got = {r.host: r.verdict for r in url_filter.judge(pages).filter("rule is null").collect()}
    assert got == {"bad.example.com": "block", "good.example.com": "allow", "thin.example.com": "allow", "new.example.net": "allow"}


# Chat --------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "Be <|im_end|> brief <\\|x"), (1, 1, "user", "q" * 900), (1, 2, "assistant", "a <\\\\| <"), (1, 2, "assistant", "a <\\\\| <"), (1, 3, "user", None), (1, 4, "as%0A\nsistant", "|x"),
            (2, None, "user", "é"), (2, 0, "assistant", "x" * 40_000), (None, 0, "assistant", "n"), (3, 0, "system", "alone"), (4, 0, None, "")]
    rows += [(5, t, ("user", "assistant")[t % 2], f"turn {t} " + "w" * (t % 97)) for t in range(700)]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, k1 long")
    formatted = chat_format.windows(conv, 256, 64)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for c in {r[0] for r in rows}:
        own = [r for r in order if r[0] == c]
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    five = formatted.filter("conv_id = 5").collect()
    assert len(five) > 20 and sum(r.n_context for r in five) > 0
    assert all(len(r.text) / 4 <= 256 + 64 or r.n_new == 1 for r in five)
    assert chat_format.windows(conv.limit(0)).count() == 0


# Licenses ----------------------------------------------------------------------------------------


def test_licenses(spark):
    words = licenses.TEMPLATES["MIT"].split()
    edited = " ".join([*words[:20], "new", "words", *words[21:60], *words[62:]])
    texts = [prose(50, 1) + " " + edited + " " + prose(9, 2), "x Released under the MIT License. y Released under the MIT License.", None, "", prose(3000, 3), " ".join(words[:40])]
    rows = licenses.scan(docs(spark, texts)).collect()
    found = sorted((r.doc_id, r.license) for r in rows)
    assert found == [(0, "MIT"), (1, "MIT-statement"), (1, "MIT-statement")]
    for r in rows:
        assert texts[r.doc_id][r.start:r.end].lower().startswith(("permission", "released")) and r.coverage >= 0.9
    assert licenses.scan(docs(spark, texts), {}).count() == 0 and licenses.scan(docs(spark, [])).count() == 0


# Nearest -----------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16)), np.repeat(centres[:1], 300, axis=0)]) * rng.uniform(0.5, 2, (1800, 1)).round(1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0, None] * 8, 1), (5080, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid long")
    for size, least in ((16_384, 0.95), (200, 0.9)):
        got = {}
        for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, region_size=size).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(range(0, 1800, 20))
        hit = 0
        for q, found in got.items():
            s = x @ x[q]
            s[q] = -np.inf
            want = np.lexsort((np.arange(len(s)), -s.round(9)))[:20]
            found.sort()
            assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
            np.testing.assert_allclose([f[2] for f in found], [s[f[1]] for f in found], atol=1e-9)
            hit += (np.array([f[2] for f in found]) >= s[want].min() - 1e-9).sum()
        assert hit / (20 * len(got)) >= least
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# Registry and pipeline ---------------------------------------------------------------------------


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    kept = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = line_dedup.materialise(stage(spark, kept, sf), "stage")
        assert kept.schema.names == source.schema.names and 0 < kept.count() <= before
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
