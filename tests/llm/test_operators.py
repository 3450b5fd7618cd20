"""The operators against brute force, and on nulls, empty, long and repeated texts, ties, and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from valence import session  # noqa: E402
from valence.llm import (  # noqa: E402
    decontaminate, exactdedup, licenses, lmscore, neardedup, packing, pii, queries, toxicity, urlfilter, warc,
)
from valence.llm.common import mixed, training_part  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, source string, row long, id long, body string, key string, label string"
WORDS = [f"w{i}" for i in range(300)]


def _text(seed, n=80):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empties, a long text, ties, repeated rows and ids, and columns named like those inside."""
    texts = [
        (1, None), (2, ""), (3, " \n"), (None, "a  b c"), (4, "a b c"), (4, "a b c"), (5, _text(1)), (5, _text(2)),
        (6, _text(1) + " tail"), (7, _text(3, 30000)), (8, _text(3, 30000)), (9, "idiot " * 3 + _text(4)),
        (10, "x@y.zz 1.2.3.4 +1 234 567 8901 4111 1111 1111 1111"), (11, "é" * 5000),
    ]
    rows = [(i, t, None if k % 3 else "s", k, -1, "b", "k", "l") for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _counts(text, width=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return collections.Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else collections.Counter()


def test_exact_groups(odd, docs):
    for table in (odd, docs):
        rows = table.select("doc_id", "text").collect()
        groups = collections.defaultdict(list)
        for r in rows:
            groups[_plain(r.text)].append(r.doc_id)
        want = collections.Counter()
        for text, ids in groups.items():
            keep = min((i for i in ids if i is not None), default=None)
            sha = hashlib.sha256(text.encode()).hexdigest()
            want.update((i, keep, len(ids), sha) for i in ids)
        for block in (16, 4096):
            got = exactdedup.exact_groups(table, block=block).collect()
            assert collections.Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
            assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)


def test_near_groups_equal_brute_force(spark, tmp_path_factory):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = _text(100 + g, 60).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "a b"), (len(rows) + 3, "A, b!")]
    path = str(tmp_path_factory.mktemp("near") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: _counts(t) for i, t in rows}
    for i in bags:
        for j in range(i):
            both = (bags[i] | bags[j]).total()
            if both and (bags[i] & bags[j]).total() >= 0.8 * both - 1e-12:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = neardedup.near_groups(spark.read.parquet(path)).collect()
    assert {r.id: r.class_id for r in got} == {i: find(i) for i in root}
    sizes = collections.Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.id == r.class_id) for r in got)


def test_dart_signatures_agree_as_often_as_the_weights_are_alike():
    a = {1: 3.0, 2: 1.0, 3: 0.5, 4: 7.0, 5: 2.0}
    b = {1: 1.0, 2: 1.0, 3: 2.5, 4: 5.0, 6: 1.0}
    alike = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    key = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text = np.array([0] * len(a) + [1] * len(b))
    signs = neardedup.dart_signatures(key, text, np.array([*a.values(), *b.values()]), 2, 4000)
    assert abs((signs[0] == signs[1]).mean() - alike) < 0.04


def test_near_groups_on_odd_rows(odd):
    got = neardedup.near_groups(odd).collect()
    of = {r.row: r for r in got}
    assert len(of) == 14 and sum(r.id in (7, 8) and r.class_id == 7 for r in got) == 2
    assert sum(r.class_size == 1 for r in got if r.id in (1, 2, 3)) == 3
    assert sum(r.class_id == 4 for r in got) == 3 and sum(r.kept for r in got if r.class_id == 4) == 1


def test_contamination(spark, odd):
    item = _text(1)[:200].rsplit(" ", 1)[0]
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "a b c"), (5, "p q r s t u v")], "item_id long, text string")
    got = decontaminate.contamination(odd, bench).collect()
    assert sorted(r.id for r in got if r.contaminated) == [5, 6] and len(got) == 14
    words = item.split()
    for k in (6, 14, 22):
        words[k] = "other"
    changed = spark.createDataFrame([(1, _text(9) + " " + " ".join(words) + " " + _text(8)), (2, "p q r s t u v"), (3, _text(9))], "doc_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(changed, bench).orderBy("id").collect()] == [True, True, False]


def test_lm_scores(odd, monkeypatch):
    rows = odd.select("doc_id", "text").collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", low(r.text)), None]) for r in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens]
    c = collections.Counter(w for (_, t), h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = c.total(), len(c)
    want = sorted((len(t), sum(w in c for w in t), h, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 3)) for (_, t), h in zip(tokens, held, strict=True))
    pairs = collections.Counter(p for (_, t), h in zip(tokens, held, strict=True) if not h for p in zip([None, *t], t))
    level = lambda k: 0.75 * 2 ** k.bit_length() - 0.5 if k else 0.0

    def score(text):
        """By the same levels of exact counts."""
        out = 0.0
        for h, w in zip([None, *text], text):
            both = min(level(pairs[h, w]), level(c[h]), level(c[w]))
            out += math.log10((both + lmscore.MU * (level(c[w]) + 0.5) / (n + 0.5 * (v + 1))) / (level(c[h]) + lmscore.MU))
        return out

    scores = sorted(score(t) for _, t in tokens)
    # All common bigrams in the broadcast part, some, none; all words broadcast, some, none; one segment, several parts of them.
    for segment, more in ((1 << 19, {}), (256, {"limit": 0}), (256, {"limit": 300, "common": 20}), (1 << 19, {"common": 0})):
        monkeypatch.setattr(lmscore, "SEGMENT", segment)
        got = lmscore.lm_scores(odd, use=training_part("doc_id", 1), **more).collect()
        assert sorted((r.n_tokens, r.n_known, r.held_out, round(r.base_score, 3)) for r in got) == want
        assert all(r.train_tokens == n for r in got)
        # A probe may find a level too high, never one too low: some pairs score a little more.
        assert all(-1e-6 < r - s < 0.002 * abs(s) + 1e-6 for r, s in zip(sorted(r.score for r in got), scores, strict=True))


def test_lm_answers_are_one_row_for_a_text(odd, monkeypatch):
    """However many tasks have the segments: what they find is summed up by batch, and not a row for each text and task."""
    rest_scores, made = lmscore.rest_scores, []

    def counted(*given):
        rest = rest_scores(*given)
        made.append((rest.count(), rest.select("row").distinct().count(), given[0].filter("part IS NULL").count()))
        return rest

    monkeypatch.setattr(lmscore, "rest_scores", counted)
    monkeypatch.setattr(lmscore, "SEGMENT", 1 << 10)
    for more in ({"limit": 0}, {"limit": 0, "common": 4}):
        lmscore.lm_scores(odd, use=training_part("doc_id", 1), **more).collect()
        rows, texts, every = made.pop()
        assert 0 < rows == texts <= every


def test_filter_never_undercounts():
    keys = mixed(np.arange(1, 2000, dtype=np.uint64))
    level = 1 + np.arange(len(keys)) % 9
    words = np.zeros((3, 4000), np.uint64)
    for k in range(1, 10):
        live = keys[level >= k]
        segment, place, mask = lmscore.Filter.places(live, k, 3, 4000)
        np.bitwise_or.at(words, (segment, place), mask)
    read = lmscore.Filter(words).levels(keys)
    assert (read >= level).all() and (read > level).mean() < 0.1


def test_toxicity(spark, odd):
    train = [(k, _text(k) + (f" idiot {_text(-k, 3)} moron" if k % 2 else "")) for k in range(1000, 1120)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(train, "doc_id long, text string"))
    labels = _labels(spark, [(k, 1, k % 2) for k, _ in train] + [(None, 1, 1), (3, 0, None)])
    got = {r.id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[9].score > 0.5 and all(got[i].score < 0.5 for i in (1, 2, 3, 6, 7, 10, 11))
    assert all((got[k].score >= 0.5) == bool(k % 2) for k, _ in train)
    assert [(s.start, s.end) for s in got[9].spans] == [(0, 5), (6, 11), (12, 17)]
    assert all(r.score == 0 for r in toxicity.toxicity(odd, labels.limit(0)).collect())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    score, steps = rng.normal(size=5), rng.normal(size=(2, 2))
    paths = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
    weight = np.array([math.exp(sum(s * y for s, y in zip(score, p, strict=True)) + sum(steps[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
    want = (weight[:, None] * np.array(paths)).sum(0) / weight.sum()
    got, pairs = toxicity.forward_backward(score, steps, np.zeros(5, int), np.arange(5), 1)
    assert np.allclose(got, want) and math.isclose(pairs.sum(), 4)


def test_licenses(spark, odd):
    mit = dict(queries.TEMPLATES)["mit"]
    words = mit.split()
    words[10] = "changed"
    rows = [(1, _text(1) + " " + " ".join(words) + " " + _text(2)), (2, "Released under the MIT License."), (3, mit[:200]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = {(r.id, r.template_id): r for r in licenses.license_matches(docs, queries.templates(spark)).collect()}
    assert set(got) == {(1, "mit"), (2, "mit-line")} and got[1, "mit"].containment >= 0.8
    assert rows[1][1][got[2, "mit-line"].start : got[2, "mit-line"].end] == "Released under the MIT License"


def test_url_rules(spark):
    urls = [None, "", "x", "http://COM", "http://com/", "http://a.Example.com/en/q?x", "ftp://net/es/#", "ftp://xnet/es/", "q://www.example.com/en/"]
    urls += [f"http://{random.Random(k).choice(['a.net', 'b.com', 'www.example.com'])}/{random.Random(-k).choice(['en', 'fr', 'es'])}/{k}" for k in range(300)] + ["http://hot.net/fr/"] * 200
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def judge(url):
        if "://" not in (url or ""):
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.lower()
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[3:] if fits else (None, "allow"))

    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(table, queries.rules(spark)).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert {r.verdict for r in urlfilter.judged(table, queries.rules(spark).limit(0)).collect()} == {"allow"}


def test_archives(spark, tmp_path_factory):
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:valence:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 y WARC/1."
    rows = [(1, "a", fake), (2, None, None), (3, "u\r\nv", "é" * 100), (4, "b", fake), (None, "c", "zz"), (5, "d", ""), (7, "e", "same"), (7, "e", "same"), (9, "e", fake * 50)]
    path = str(tmp_path_factory.mktemp("warc") / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # so that splits begin inside records
    try:
        got = warc.archived(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(i, len((h or "").encode()), sha(h), *{4: ("revisit", 1), 5: ("revisit", 2)}.get(i, ("response", None))) for i, _, h in rows[:-2]]
    want += [(7, 4, sha("same"), "revisit", 7), (9, len((fake * 50).encode()), sha(fake * 50), "response", None)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_packing(odd, docs):
    for table in (odd, docs):
        out = packing.packed(table, capacity=256, shard=50).toPandas()
        source = {r.row: r.source for r in table.selectExpr("monotonically_increasing_id() AS row", "source").collect()}
        bins = out.groupby(["shard", "bin"])
        assert bins.n_tokens.sum().max() <= 256
        for _, b in bins:
            known = [s for s in map(source.get, b["row"]) if s is not None]
            assert len(known) == len(set(known))
            ends = sorted(zip(b["start"], b["start"] + b.n_tokens, strict=True))
            assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
        size = {r.row: len(_plain(r.text).split()) + 1 for r in table.selectExpr("monotonically_increasing_id() AS row", "text").collect()}
        assert out.groupby("row").n_tokens.sum().to_dict() == size


def _base(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark, odd, docs, plan):
    more = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 0001.02.03.255 1.2.3.256", "é😀 a.b@c.d 😀 4111111111111111", "x" * 3000 + "@" + "y" * 3000 + ".z", "1" * 5000, "1-1 " * 3000]
    extra = spark.createDataFrame([(-k, t) for k, t in enumerate(more, 1)], "doc_id long, text string")
    table = odd.select("doc_id", "text").union(extra).union(docs.select("doc_id", "text"))
    found = pii.personal_data(table)
    assert not re.search("Python|Pandas|Arrow", plan(found))
    want = collections.Counter((r.doc_id, _base(r.text or "")) for r in table.collect())
    assert collections.Counter((r.id, r.b) for r in found.select("id", pii.listed(found["base"]).alias("b")).collect()) == want
    assert pii.personal_data(table.limit(0)).count() == 0


def test_operators_on_empty_tables(spark, odd):
    none, bench = odd.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert exactdedup.exact_groups(none).count() == neardedup.near_groups(none).count() == packing.packed(none).count() == 0
    assert lmscore.lm_scores(none).count() == licenses.license_matches(none, queries.templates(spark)).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench).collect())


def test_pipeline(spark, docs):
    """Each stage by what it should keep, worked out from the operators' brute-force rules above."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.id for r in toxicity.toxicity(docs, labels, use=training_part("doc_id", 0)).collect() if r.score >= 0.5}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    seen = {}
    for i in sorted(left):
        seen.setdefault(_plain(left[i]), i)
    left = {i: left[i] for i in seen.values()}
    bags, kept = {i: _counts(t) for i, t in left.items()}, []
    root = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if j < i and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total() > 0:
                root[i] = min(root[i], root[j])
    kept = {i: t for i, t in left.items() if root[i] == i}
    norm = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i, t in kept.items() if not any(x in norm(t) for x in items)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept


def test_rows_keep_their_numbers_when_files_are_cut_differently(spark, tmp_path_factory, monkeypatch):
    """Each table written changes how files are cut from then on, as executors that come and go do."""
    texts = [f"{_text(k, 40)} {'Released under the MIT License.' if k % 3 == 0 else ''}" for k in range(12)]
    texts += [texts[1], texts[5], texts[7] + " tail", texts[8] + " tail"]
    folder = tmp_path_factory.mktemp("cut")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(folder / "docs"))
    table = spark.read.parquet(str(folder / "docs"))
    items = spark.createDataFrame([(k, texts[k]) for k in (2, 4)], "item_id long, text string")
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(k, f"u{k}", t if k % 2 else fake * k) for k, t in enumerate(texts)] + [(99, "u", fake * 8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(str(folder / "pages"))
    pages = spark.read.parquet(str(folder / "pages"))
    runs = {
        "exact": lambda: exactdedup.without_copies(table), "near": lambda: neardedup.without_near_copies(table),
        "leaks": lambda: decontaminate.contamination(table, items), "clean": lambda: decontaminate.decontaminated(table, items),
        "scores": lambda: lmscore.lm_scores(table, use=training_part("doc_id", 1)),
        "licenses": lambda: licenses.license_matches(table, queries.templates(spark)), "warc": lambda: warc.archived(pages).drop("file", "offset"),
    }
    sizes = {"128m": "1500", "1500": "128m"}

    def shifted(df, purpose):
        out = session.written(df, purpose)
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes.get(spark.conf.get("spark.sql.files.maxPartitionBytes"), "1500"))
        return out

    def rows(name):
        return sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "row"}) for r in runs[name]().collect())

    want = {name: rows(name) for name in runs}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for module in (decontaminate, exactdedup, licenses, lmscore, neardedup, warc):
        monkeypatch.setattr(module, "written", shifted)
    got = {}
    try:
        for name in runs:
            for first in sizes:
                spark.conf.set("spark.sql.files.maxPartitionBytes", first)
                got[name, first] = rows(name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [k for k in got if got[k] != want[k[0]]] == []


def test_numbers_of_rows(spark, odd):
    from valence.llm.common import fixed, row_of

    def numbers(df):
        return df.select(row_of(df))

    many = odd.unionByName(odd).withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    for table, n in ((odd, 14), (odd.filter("doc_id IS NOT NULL").select("text"), 13), (many, 56), (odd.sample(0.99, 1), None), (odd.limit(0), 0)):
        found = [r[0] for r in numbers(fixed(table)).collect()]
        assert len(set(found)) == len(found) and n in (None, len(found))
    assert sorted(numbers(fixed(odd, "text")).collect()) == sorted(numbers(fixed(odd)).collect())


def test_every_overlap_of_a_short_item_is_found(spark, tmp_path_factory):
    """All patterns of up to three replaced words in items of 5 to 16 words, and in one of 19 more of them, against brute force."""
    import itertools

    def matched(same):
        now = equal = score = best = 0
        for s in same:
            now = max(0, now + (1 if s else -2))
            equal = equal + s if now else 0
            if now > score:
                score, best = now, equal
        return best if score >= 5 else 0

    items, rows, want = [], [], set()
    for n in (*range(5, 17), 19):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for replaced in itertools.chain.from_iterable(itertools.combinations(range(n), r) for r in range(4 if n < 19 else 6)):
            found = matched([k not in replaced for k in range(n)])
            text = " ".join("zz" if k in replaced else w for k, w in enumerate(words))
            rows.append((len(rows), f"before it {text} after it"))
            if found >= math.ceil(decontaminate.COVER * n) or found >= decontaminate.ENOUGH:
                want.add((rows[-1][0], n))
    path = str(tmp_path_factory.mktemp("short") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = decontaminate.contamination(spark.read.parquet(path), spark.createDataFrame(items, "item_id long, text string")).filter("contaminated")
    found = {(r.id, r.first_item) for r in got.collect()}
    assert (sorted(want - found)[:5], sorted(found - want)[:5]) == ([], [])


def test_long_candidates_are_proposed_whole(spark):
    texts = [
        "secret=" + "a1" * 150, "x" * 30, "a" * 100 + "@" + "b" * 300, "n " + "1234 " * 9 + ".", "7" * 40,
        "v 1.2.3.4.5.6.7.8.9.10", "v 1.2.1234567", "9" * 20000 + " " + "1." * 5000 + "1", "1.2.3 123456",
    ]
    rows = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.id: sorted((pii.KINDS[x.kind], x.match) for x in r.wider) for r in rows}
    want = [("token", "a1" * 150)], [("token", "x" * 30)], [("address", texts[2])], [("number", texts[3][2:-2])], [("number", "7" * 40)], \
        [("dotted", texts[5][2:])], [("dotted", texts[6][2:])], [("number", texts[7]), ("dotted", texts[7].split()[1])]
    for k, spans in enumerate(want):
        assert set(spans) <= set(got[k]), (k, [(a, b[:40], len(b)) for a, b in got[k]])
    assert got[8] == [("dotted", "1.2.3"), ("number", "1.2.3 123456"), ]
    assert all(len(set((x.kind, x.start, x.end) for x in r.wider)) == len(r.wider) for r in rows)
    assert all(texts[r.id][x.start : x.end] == x.match for r in rows for x in r.wider)
