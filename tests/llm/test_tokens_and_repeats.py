"""Alignment, repeated strings, fill-in-the-middle and packing against brute force; and what all operators must stand."""

import collections
import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from valence.llm import (  # noqa: E402
    alignment, common, decontaminate, exactdedup, fillmiddle, licenses, lmscore, neardedup, packing, pii, queries, suffixes,
    toxicity, urlfilter, warc,
)

SF = "/root/testdata/sf0.001"
BIG = 1 << 60


def _text(seed, n=80):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)], k=n))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, ids that no float holds, odd texts, and columns named like those inside."""
    texts = [
        None, "", " \n", "a  b c", "a  b c", _text(1), _text(1) + " tail", _text(3, 30000), _text(3, 30000), "é" * 700 + "😀", "x\0y\0",
        "▁piece <s> </s> <unk>", "a <|endoftext|> b", "<P>x<S>", "aaaa" * 300, " " * 5000 + "z", "q" * 3000, "  \u0085 x\r\n\ty ",
    ]
    ids = [BIG + 1, BIG + 3, None, None, *range(BIG + 5, BIG + 5 + 2 * (len(texts) - 5), 2), BIG + 5]
    rows = [(i, t, "s", -1, -2, "b", "i", 3, 4) for i, t in zip(ids, texts, strict=True)]
    columns = "doc_id long, text string, source string, row long, id long, body string, own_text string, _valence_row long, _row0 long"
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, columns).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def test_alignment_equals_brute_force(odd, docs):
    paths = [alignment.installed(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    v = alignment.vocabularies(*paths)
    for table in (odd, docs):
        rows, links, want = table.select("doc_id", "text").collect(), collections.Counter(), []
        for r in rows:
            a = v.a.slow.encode(" " + (r.text or ""), add_special_tokens=False).ids
            b = v.b.model.encode(r.text or "")
            joined = [b"".join(side.entries[k] for k in ids) for side, ids in ((v.a, a), (v.b, b))]
            if not r.text or joined != [(" " + r.text).encode()] * 2:
                want.append((r.doc_id, 0, 0, [], ""))
                continue
            ends = {end: k for k, end in enumerate(np.cumsum([len(v.a.entries[k]) for k in a]).tolist())}
            groups, mine, last, at = [], [], [0, 0], 0
            for j, k in enumerate(b):
                at += len(v.b.entries[k])
                if at in ends:
                    i = ends[at]
                    groups.append(",".join(map(str, a[last[0] : i + 1])) + "|" + ",".join(map(str, b[last[1] : j + 1])))
                    last = [i + 1, j + 1]
                    mine.append((a[i], k))
            links.update(mine)
            want.append((r.doc_id, len(a), len(b), mine, _sha(";".join(groups).encode())))
        highest = collections.Counter()
        for (_, b), n in links.items():
            highest[b] = max(highest[b], n)
        want = [(i, a, b, len(m), len(m), sum(links[x] == highest[x[1]] for x in m), sum(links[x] for x in m), s) for i, a, b, m, s in want]
        out = alignment.alignment(table, *paths).collect()
        got = [(r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out]
        assert collections.Counter(got) == collections.Counter(want)
        shown = {(x.a, x.b): x["count"] for r in out for x in r.links}
        assert shown == dict(links) and all(sum(x.times for x in r.links) == r.n_links for r in out)
    assert sum(x[-1] != "" for x in want) > 190  # most texts are rebuilt by both sides
    assert alignment.alignment(odd.limit(0), *paths).count() == 0


def test_lockstep_in_lanes_of_any_length():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 5, 5, 900, 1000])
    for share in (0.1, 0.5, 1.0):
        ends = [np.unique(np.concatenate([np.flatnonzero(rng.random(1000) < share) + 1, bounds[1:]])) for _ in range(2)]
        ends = [e[e > 0] for e in ends]
        both = np.intersect1d(*ends)
        for lane in (1, 7, 1024):
            a, b = alignment.lockstep(*ends, bounds, lane)
            assert (ends[0][a] == both).all() and (ends[1][b] == both).all()


def _repeats(rows):
    """For each (id, row, bytes): id, bytes, bytes removed, spans, digest, by looking up every window."""
    seen, out = set(), []
    for i, _, b in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = len(re.findall(b"\1+", bytes(covered)))
        out.append((i, len(b), sum(covered), spans, _sha(bytes(x for x, c in zip(b, covered) if not c))))
    return collections.Counter(out)


def _removed(table, **more):
    out = suffixes.without_repeats(table, **more).collect()
    return collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), out


def _numbered(table):
    rows = common.numbered(common.fixed(table, "doc_id", "text"), "text", "doc_id").collect()
    return [(r.own_doc_id, r.row, r.body.encode()) for r in rows]


def test_repeats_equal_brute_force(spark, odd, docs, tmp_path_factory):
    for table in (odd, docs):
        got, out = _removed(table)
        assert got == _repeats(_numbered(table)) and any(r.n_removed for r in out)
        assert all(_sha(bytes(r.kept)) == r.kept_sha256 and sum(s.upto - s.start for s in r.spans) == r.n_removed for r in out)
    assert suffixes.without_repeats(odd.limit(0)).count() == 0


def test_repeats_of_hot_leads_and_windows(spark, tmp_path_factory, monkeypatch):
    """So few hulls a bucket and a lead that leads are hot, frequent windows straddle buckets, and buckets have boundaries."""
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefgh ", k=130))
    rows = []
    for k in range(120):
        kind = k % 4
        text = "".join(rng.choices("ab", k=rng.randint(0, 400))) if kind == 0 else "xyz" * rng.randint(0, 150)
        if kind > 1:
            text = "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90))) + line[: rng.randint(60, 130)] + "".join(rng.choices("abcdefgh ", k=60))
        rows.append((rng.choice([None, k, k // 3, BIG + k]), text))
    path = str(tmp_path_factory.mktemp("hot") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    table = spark.read.parquet(path)
    want = _repeats(_numbered(table))
    for hot, bucket, sample in ((4096, 1 << 14, 20000), (4096, 20, 7), (2, 20, 20000), (0, 9, 5)):
        for name, value in (("HOT", hot), ("BUCKET", bucket), ("SAMPLE", sample)):
            monkeypatch.setattr(suffixes, name, value)
        assert _removed(table, kept_text=False)[0] == want


def test_repeats_in_a_text_of_several_segments(spark):
    body = np.random.default_rng(1).integers(97, 123, suffixes.SEGMENT + 5000, dtype=np.uint8).tobytes().decode()
    at = suffixes.SEGMENT - 60
    rows = [(1, body + body[at : at + 300]), (2, body[at - 10 : at + 190]), (3, body[-150:] + "-")]
    got, _ = _removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _repeats([(i, i, t.encode()) for i, t in rows])


def test_multikey_sort_and_shared():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        rows = rng.integers(0, 3, (n, 21), dtype=np.uint8)
        order = suffixes.multikey_sort(rows)
        held = [bytes(rows[k]) for k in order]
        assert held == sorted(held) and sorted(order.tolist()) == list(range(n))
        lengths = suffixes.shared(rows, order)
        for k in range(1, n):
            assert lengths[k] == next((j for j in range(21) if held[k][j] != held[k - 1][j]), 21)


def test_fill_in_middle(odd, docs):
    unit = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    for table in (odd, docs):
        want = collections.Counter()
        for r in table.select("doc_id", "text").collect():
            text = r.text or ""
            u = unit.findall(text)
            assert "".join(u) == text
            h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
            low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
            pre, mid, suf = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
            form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
            out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
            sizes = (None, None) if form == "plain" else (len(pre), len(mid))
            want[r.doc_id, len(u), form, *sizes, _sha(out.encode()), _sha(text.encode()), out, text] += 1
        made = fillmiddle.fill_in_middle(table)
        back = {(r.id, r.output): r.text for r in fillmiddle.restored(made, "output", "form", "id", "output").collect()}
        got = [(*(r[c] for c in ("id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")), back[r.id, r.output]) for r in made.collect()]
        assert collections.Counter(got) == want
        assert {x[2] for x in got} == {"plain", "spm", "psm"} or table is odd
    assert fillmiddle.fill_in_middle(odd.limit(0)).count() == 0


def test_cuts_at_every_place():
    for text in (b"", b"a", b"< <P <S<", b" a  b \n"):
        units = fillmiddle.Units(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        n = int(units.count()[0])
        for low in range(n + 1):
            for high in range(low, n + 1):
                parts = fillmiddle.cut((memoryview(text), 0, len(text)), units.after(0, low), units.after(0, high))
                for form in ("psm", "spm"):
                    out = b"".join(fillmiddle.stream(fillmiddle.arranged(parts, form)))
                    assert b"".join(fillmiddle.stream(fillmiddle.rebuilt(out, form))) == text


def test_packing_is_best_fit_with_conflicts(spark):
    """Each piece goes to the tightest bin that is open and has neither its source nor a cluster of it, longest first."""
    rng = random.Random(4)
    rows = [(None if k % 17 == 0 else BIG + k, " ".join(["w"] * rng.randint(0, 40)), rng.choice([None, "s", "t", f"u{k % 40}"]), rng.choice([None, "c", f"d{k % 30}"])) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string")
    out = packing.packed(table, cluster="cluster", capacity=32, shard=90).collect()
    assert collections.Counter(r.id for r in out if r.piece == 0) == collections.Counter(i for i, *_ in rows)
    known = {r.row: r for r in common.numbered(table, "text", "source", "cluster").collect()}
    shards = collections.defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    assert len([s for s in shards if s >= 0]) > 2
    for shard, pieces in shards.items():
        bins = []
        for r in sorted(pieces, key=lambda r: (-r.n_tokens, r.row)) if shard >= 0 else ():
            own = {("s", known[r.row].own_source), ("c", known[r.row].own_cluster)}
            own = {x for x in own if x[1] is not None}
            fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= r.n_tokens and not b["has"] & own and b["room"] > 0]
            if fits:
                k = min(fits)[1]
            else:
                k = len(bins)
                bins.append({"room": 32, "has": set()})
            assert (r.bin, r.start) == (k, 32 - bins[k]["room"])
            bins[k]["room"] -= r.n_tokens
            bins[k]["has"] |= own


def test_near_copies_do_not_share_a_bin(spark):
    base = _text(5, 120).split()
    rows = []
    for k in range(30):
        words = list(base)
        words[3 * k] = "other"
        rows.append((k, " ".join(words), None))
    rows += [(100 + k, _text(200 + k, 60), None) for k in range(200)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    bins = collections.Counter((r.shard, r.bin) for r in out if r.id < 100)
    assert max(bins.values()) <= 2 and len(bins) >= 27


def test_all_operators_on_large_ids_and_clashing_names(spark, odd, tmp_path_factory):
    ids = collections.Counter(r.doc_id for r in odd.select("doc_id").collect())
    labels = spark.createDataFrame([(BIG + 5, 1, 1), (BIG + 7, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(BIG + 1, _text(1)), (None, None)], "item_id long, text string")
    found = {
        "op2": decontaminate.contamination(odd, bench), "op3": lmscore.lm_scores(odd), "op4": toxicity.toxicity(odd, labels),
        "op7": exactdedup.exact_groups(odd), "op8": neardedup.near_groups(odd), "op10": pii.personal_data(odd),
        "op9": packing.packed(odd).filter("piece = 0"), "op12": suffixes.without_repeats(odd),
    }
    for name, df in found.items():
        assert collections.Counter(r.id for r in df.select("id").collect()) == ids, name
    assert {r.id for r in licenses.license_matches(odd, queries.templates(spark)).select("id").collect()} <= set(ids)
    # Without labels there is nothing toxic to learn.
    for kept in (toxicity.clean_only(odd, labels.limit(0)), exactdedup.without_copies(odd), neardedup.without_near_copies(odd), decontaminate.decontaminated(odd, bench)):
        assert kept.columns == odd.columns
        assert 10 <= kept.count() < odd.count() + 1 and kept.filter("_valence_row = 3 and _row0 = 4").count() == kept.count()
    pages = [(BIG + 1, "http://a.com/x", "<p>"), (BIG + 3, None, None), (None, "http://example.com/en/", "<p>")]
    path = str(tmp_path_factory.mktemp("pages") / "pages")
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_valence_row", F.lit(1)).write.parquet(path)
    pages = spark.read.parquet(path)
    assert {r.id: r.verdict for r in urlfilter.judged(pages, queries.rules(spark)).collect()} == {BIG + 1: "allow", BIG + 3: "allow", None: "block"}
    assert {(r.page_id, r.refers_to) for r in warc.archived(pages).collect()} == {(BIG + 1, None), (BIG + 3, None), (None, BIG + 1)}


def test_operators_and_pipeline_on_empty_tables(spark, odd, tmp_path_factory):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert urlfilter.judged(pages, queries.rules(spark)).count() == warc.archived(pages).count() == 0
    sf = str(tmp_path_factory.mktemp("empty"))
    for name, df in (("documents", odd.limit(0)), ("labels", labels), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_segments_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 256)
    texts = [bytes([65 + k % 26]) * n for k, n in enumerate((0, 99, 100, 255, 256, 257, 700, 1500, 3))]
    seen = collections.Counter()
    for data, bounds, texts_, offsets in suffixes.segments(pa.array(texts, pa.binary())):
        for k, t in enumerate(texts_.tolist()):
            seen.update((t, int(offsets[k]) + p) for p in range(int(bounds[k + 1] - bounds[k]) - 99))
    assert seen == collections.Counter({(t, p): 1 for t, x in enumerate(texts) for p in range(len(x) - 99)})
