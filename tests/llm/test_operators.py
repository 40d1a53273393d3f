"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key_a string, count int, shard_ string, plan string, cuts int, _ int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


PASSAGE = ". ".join(words(900 + i, 9) for i in range(7)) + "."


def corpus() -> list[tuple]:
    texts = [words(i, 40 + i) + "." for i in range(30)]
    texts += [texts[3], texts[3], texts[3].replace(" ", "\n\t"), texts[5] + " Extra. " + PASSAGE, "First here. " + PASSAGE + " " + words(77, 20)]
    texts += ["", "   ", None, None, "one", "one two", words(5, 30_000), "Er. " * 300, "IDIOT you are", "“Straße” naïve 中文 ²"]
    rows = [(i, t, "en" if i % 3 else "de", ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, "a"), (None, None, None, None), rows[4], rows[4]]
    return [(*r, len(r[1] or ""), "k", 1, "s", "p", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_groups(docs, rows, empty):
    from loomline.llm.op03_exact_dedup import exact_groups

    norm = lambda t: re.sub(f"[{SPACES}]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    for digests in ("all", "surviving"):
        got = exact_groups(docs, digests=digests).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        want = Counter()
        for r in rows:
            own = groups[norm(r[1])]
            want[r[0], min((x for x in own if x is not None), default=None), len(own)] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    digest = {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    assert {r.text_sha256 for r in exact_groups(docs, digests="all").collect()} == digest
    assert exact_groups(empty).count() == 0


def test_quality_ledger(docs, rows, empty):
    from loomline.llm.op08_quality_rules import BASE, RULES, STANDARD, ablation, ledger, verdict

    def repeats(w):
        runs = defaultdict(list)
        for i in range(len(w) - 4):
            runs[tuple(w[i : i + 5])].append(i)
        return len({p + k for at in runs.values() if len(at) > 1 for p in at for k in range(5)})

    want = Counter()
    for r in rows:
        w = re.findall(f"[^{SPACES}]+", r[1] or "")
        lines = [x for x in (r[1] or "").split("\n") if x.strip(SPACES)]
        want[r[0], len(w), sum(map(len, w)), repeats(w), len(lines) - len(set(lines))] += 1
    book = ledger(docs)
    got = book.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) for r in got) == want
    failing = {r.rule: (r.failing, r.only_this) for r in ablation(book, STANDARD).collect()}
    for b, rule in enumerate(RULES):
        assert failing[rule] == (sum(r.fail_bits >> b & 1 for r in got), sum(r.fail_bits == 1 << b for r in got))
    assert book.where(verdict(BASE)).count() == sum(r.fail_bits & BASE.mask == 0 for r in got)
    assert ledger(empty).count() == 0


def reference_print(text):
    w = (text or "").encode().lower().split()
    from xxhash import xxh64_intdigest

    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(docs, rows, empty):
    from loomline.llm.op09_simhash import hex_digits, near_duplicates

    got = near_duplicates(docs).withColumn("hex", hex_digits(F.col("fp"))).collect()
    prints = {r[1]: reference_print(r[1]) for r in rows}
    assert Counter((r.doc_id, r.hex) for r in got) == Counter((r[0], f"{prints[r[1]]:016x}") for r in rows)
    nodes = sorted(set(prints.values()))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        c = find(prints[r[1]])
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], least[find(prints[r[1]])]) for r in rows)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_links_lose_no_neighbour(spark, hot):
    """Lists by cleared bits and pairs give the same components as comparing all."""
    from loomline.llm.op09_simhash import _signed, components, links

    r = random.Random(3)
    nodes = {r.getrandbits(64) for _ in range(40)}
    for n in list(nodes)[:20]:
        for _ in range(6):
            nodes.add(n ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    df = spark.createDataFrame([(_signed(n),) for n in nodes], "fp long")
    got = {x.node: x.root for x in components(links(df, len(nodes), hot)).collect()}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(_signed(n))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


@pytest.mark.parametrize("hot_bucket", [64, 2])
def test_similar_groups(spark, rows, empty, hot_bucket):
    from loomline.llm.minhash import similar_groups

    def edited(text: str, seed: int, edits: int) -> str:
        r, w = random.Random(seed), text.split()
        for _ in range(edits):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        return " ".join(w)

    texts = [(x[0], x[1]) for x in rows]
    for k in range(12):
        base = words(8000 + k, 200)
        texts += [(1000 + 10 * k + e, edited(base, 10 * k + e, e * (1 + k % 3))) for e in range(8)]
    texts += [(5000, words(8000, 200).upper())]
    texts += [(6000 + i, edited(words(8100, 300), i, i % 4)) for i in range(40)]

    def sets(t):
        w = (t or "").lower().split()
        return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) > 5 else frozenset([tuple(w)] if w else [])

    made = [sets(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, a in enumerate(made):
        for j in range(i):
            both = len(a & made[j])
            if a == made[j] or both * 18 >= 8 * (len(a) + len(made[j])) > 0:
                near += a != made[j]
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[find(i)] += [] if d is None else [d]
    want = Counter((d, min(least[find(i)], default=None)) for i, (d, _) in enumerate(texts))
    assert near > 50
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter((x.doc_id, x.component_id) for x in similar_groups(frame, hot_bucket=hot_bucket).collect()) == want
    assert similar_groups(empty).count() == 0


@pytest.mark.parametrize("full_block", [1024, 4])
def test_similar_documents(spark, rows, empty, full_block):
    """SimHash with an exact check gives the components of brute force; small sets and a group of copies that are not all alike included."""
    from loomline.llm import op09_simhash as op9

    def edited(text: str, seed: int, edits: int) -> str:
        r, w = random.Random(seed), text.split()
        for _ in range(edits):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        return " ".join(w)

    texts = [(x[0], x[1]) for x in rows]
    texts += [(1000 + 10 * k + e, edited(words(8000 + k, 200), 10 * k + e, e * (1 + k % 3))) for k in range(12) for e in range(8)]
    texts += [(5000, words(8000, 200).upper())]
    texts += [(6000 + i, edited(words(8100, 150), i, i % 9)) for i in range(700)]
    for k in range(30):  # 4 to 14 shingles, and some words less at either end
        w = words(9000 + k, 8 + k % 11).split()
        texts += [(7000 + 10 * k, " ".join(w)), (7001 + 10 * k, " ".join(w[1:])), (7002 + 10 * k, " ".join(w[:-2])), (7003 + 10 * k, " ".join([*w[:-1], "other"]))]

    def sets(t):
        w = (t or "").lower().split()
        return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) > 5 else frozenset([tuple(w)] if w else [])

    made = [sets(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, a in enumerate(made):
        for j in range(i):
            both = len(a & made[j])
            if a == made[j] or both * 18 >= 8 * (len(a) + len(made[j])) > 0:
                near += a != made[j]
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[find(i)] += [] if d is None else [d]
    want = Counter((d, min(least[find(i)], default=None)) for i, (d, _) in enumerate(texts))
    alone = sum(len(least[find(i)]) == 1 for i, (d, _) in enumerate(texts) if d and 6000 <= d < 6700)
    assert near > 10_000 and 100 < alone < 600
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter((x.doc_id, x.component_id) for x in op9.similar_documents(frame, full_block=full_block).collect()) == want
    assert op9.similar_documents(empty).count() == 0


def test_near_dedup_stage_drops_similar(spark, tmp_path):
    import corpus_pipeline

    a = words(8500, 200)
    b = a.replace(a.split()[60], "changed", 1).replace(a.split()[120], "changed", 1)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate([a, b, words(8501, 200)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [0, 2]


def test_near_dedup_stage_makes_no_rows_for_pairs(spark, tmp_path, monkeypatch):
    """A group of copies of which many are not similar enough: every table written for it has a few rows for each document, not one for each pair."""
    import corpus_pipeline
    from loomline.llm import minhash, op09_simhash

    base, rows = words(8600, 150).split(), []
    for i in range(300):
        r, w = random.Random(i), list(base)
        for _ in range(i % 9):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made, write = {}, op09_simhash.materialize

    def counted(df, label):
        written = write(df, label)
        made[label] = max(made.get(label, 0), written.count())
        return written

    monkeypatch.setattr(op09_simhash, "materialize", counted)
    monkeypatch.setattr(minhash, "materialize", counted)
    assert 100 < corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).count() < 250
    assert "simhash-links" in made and max(made.values()) <= 2 * len(rows), made


def test_sharding(docs, rows, empty):
    from loomline.llm.op10_sharding import communication_matrix, shard_documents, shard_sizes, shuffled_shards

    got = shard_documents(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, shard_documents(docs).collect()))
    m = communication_matrix([5, 0, 1000, 17], shard_sizes(1022, 8), np.random.default_rng(1))
    assert m.sum(axis=1).tolist() == [5, 0, 1000, 17] and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()
    assert shuffled_shards(docs, 3).columns == [*docs.columns, "shard", "slot"]
    assert shard_documents(empty).count() == 0


def test_sharding_draws_the_hypergeometric_law():
    from math import comb

    from loomline.llm.op10_sharding import communication_matrix, hypergeometric, shard_sizes

    rng, n = np.random.default_rng(3), 20_000
    for good, bad, draws in ((7, 9, 5), (1, 30, 8), (40, 3, 20)):
        seen = Counter(hypergeometric(rng, good, bad, draws) for _ in range(n))
        want = {k: n * comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(seen) <= set(want)
        assert sum((seen[k] - w) ** 2 / w for k, w in want.items() if w > 5) < 2 * len(want) + 20
    # far beyond 10**9 rows the law is the same: of 10 good rows a twentieth is drawn
    seen = [hypergeometric(rng, 10, 2 * 10**9 - 10, 10**8) for _ in range(n)]
    assert abs(np.mean(seen) - 0.5) < 0.02 and abs(np.mean(np.array(seen) == 0) - 0.95**10) < 0.015
    # whole matrices: each of the C(5,3) ways in which the three rows of the first part fall has its share
    seen = Counter(tuple(communication_matrix([3, 2], shard_sizes(5, 2), rng)[0].tolist()) for _ in range(n))
    assert set(seen) == {(1, 2), (2, 1), (3, 0)} and abs(seen[3, 0] / n - 0.1) < 0.01 and abs(seen[1, 2] / n - 0.3) < 0.015


def test_sharding_tree_deals_out_every_part(spark):
    from loomline.llm.op10_sharding import drawn_counts

    sizes = {(i << 9) + j: (i * 37 + j * 11) % 50 + 1 for i in range(300) for j in range(3)}
    got = {r.node: r.counts for r in drawn_counts(spark.createDataFrame(list(sizes.items()), "node long, n long"), 5).collect()}
    assert {k: sum(v) for k, v in got.items()} == sizes
    assert np.ptp(np.sum(list(got.values()), axis=0)) <= 1


def test_sharding_is_uniform(spark):
    from loomline.llm.op10_sharding import shuffled_shards

    rows, seeds = spark.range(4).repartition(2), 24
    at = Counter((r.id, r.shard, r.slot) for seed in range(seeds) for r in shuffled_shards(rows, 2, seed).collect())
    assert len(at) == 16 and sum((n - seeds / 4) ** 2 / (seeds / 4) for n in at.values()) < 35


def test_mixing(docs, rows, empty):
    from loomline.llm.op04_mixing import MixSettings, mix_documents, mixed_texts

    small = MixSettings(block_words=16, shard_slots=64, piece_docs=8)
    got = mix_documents(docs, small).collect()
    sizes = lambda t: len(re.findall(f"[^{SPACES}]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], sizes(r[1])) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_documents(docs, small).collect()))
    totals = {"a": 0, "b": 0, None: 0}
    for r in rows:
        totals[r[3]] += sizes(r[1])
    target, left, open_ = {}, sum(totals.values()), {"a": 1, "b": 2, None: 3}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > 3 * totals[s]]
        for s in full or list(open_):
            target[s] = 3.0 * totals[s] if full else level * open_[s]
            left -= target[s]
            del open_[s]
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    for s in totals:
        own = [r for r in got if round(r.target, 6) == round(target[s], 6)]
        assert abs(sum(r.taken for r in own) - target[s]) <= 3 * 16 + 16
    texts = mixed_texts(docs, small)
    assert texts.columns == docs.columns
    taken = sum(r.taken for r in got)
    assert sum(sizes(r.text) for r in texts.collect()) == taken
    assert mix_documents(empty).count() == 0 and mixed_texts(empty).count() == 0


def test_permutation_is_a_bijection(spark):
    from loomline.llm.common import permuted

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_line_dedup(docs, rows, empty):
    from loomline.llm.op07_line_dedup import MIN_WORDS, dedup_lines

    split = lambda t: re.split(r"(?<=\. )(?!\n)|(?<=\n)(?!\n)", t)
    size = lambda s: max(1, len(re.findall(f"[^{SPACES}]+", s)) if "  " in s else s.count(" ") + 1)
    unique = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    first, seen = {}, []
    for i, t in unique:
        lines = [s.strip(SPACES) for s in split(t)]
        for p in range(len(lines)):
            q, n = p, 0
            while q < len(lines) and n < MIN_WORDS:
                n += size(lines[q])
                q += 1
            if n >= MIN_WORDS:
                first.setdefault(tuple(lines[p:q]), (i, p))
                seen.append((tuple(lines[p:q]), i, p, q))
    gone = defaultdict(set)
    for run, i, p, q in seen:
        j, at = first[run]
        if j != i or p >= at + q - p:
            gone[i].update(range(p, q))
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "deleted_lines"]
    want = Counter()
    for r in rows:
        cut = gone.get(r[0], set())
        text = "".join(s for k, s in enumerate(split(r[1])) if k not in cut).rstrip(SPACES) if cut else r[1]
        want[r[0], text, len(cut)] += 1
    assert Counter((r.doc_id, r.text, r.deleted_lines) for r in got.collect()) == want
    texts = " ".join(r.text or "" for r in got.collect())
    assert texts.count(PASSAGE[:60]) == 1
    assert dedup_lines(empty).count() == 0


@pytest.mark.parametrize("partitions", [1, 40])
def test_line_dedup_maximal_runs(spark, partitions):
    """Against all windows; with many ranges most classes of suffixes lie on an edge."""
    from loomline.llm.op07_line_dedup import MIN_WORDS, dedup_lines

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    pool = [words(7000 + i, n) + "." for i, n in enumerate([33, 8, 15, 1, 2, 40, 9, 12, 3, 29, 1, 1, 4])]
    r = random.Random(5)
    texts = [" ".join(pool[:3]), "Alone here. " + " ".join(pool[:3]) + " Not again."]  # one window of 33 words, then 23 more
    for _ in range(60):
        at, n = r.randrange(len(pool)), r.randint(2, 7)
        n += r.choice([0, 0, 20])
        texts.append(" ".join([words(r.randrange(10**6), 5) + ".", *(pool * 4)[at : at + n], r.choice(pool), words(r.randrange(10**6), 3) + "."]))
    split = [[s.strip(SPACES) for s in re.split(r"(?<=\. )", t)] for t in texts]
    first, seen = {}, []
    for i, lines in enumerate(split):
        size = np.cumsum([0] + [s.count(" ") + 1 for s in lines])
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                if size[q] - size[p] >= MIN_WORDS:
                    first.setdefault(tuple(lines[p:q]), (i, p))
                    seen.append((tuple(lines[p:q]), i, p, q))
    gone = defaultdict(set)
    for run, i, p, q in seen:
        j, at = first[run]
        if j != i or p >= at + q - p:
            gone[i].update(range(p, q))
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for k, v in before.items():
        spark.conf.set(k, v)
    assert got[1].text == "Alone here. Not again." and got[1].deleted_lines == 3
    for i, lines in enumerate(split):
        assert got[i].deleted_lines == len(gone[i])
        assert got[i].text == (" ".join(s for k, s in enumerate(lines) if k not in gone[i]))


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    from loomline.llm.op06_packing import Encoder, best_fit, pack, pack_documents

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    r = random.Random(1)
    odd = ["".join(r.choice(" \n\t'sré²!中\xa0\u2028aB<|>") for _ in range(20)) for _ in range(500)] + ["x<|endoftext|>y"]
    for text, octets in zip(odd, Encoder(path).encode(odd), strict=True):
        assert octets == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    got = pack_documents(docs).collect()
    ids = {t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in {x[1] for x in rows}}
    want = Counter()
    for x in rows:
        a = ids[x[1]]
        cuts = [0, *range((len(a) - 1) % 2048 + 1, len(a) + 1, 2048)]
        for k, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[x[0], k, b, e - b, crc32(a[b:e].tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(x.length for x in got) // 2048) + 1
    assert pack_documents(empty).count() == 0
    spark = docs.sparkSession
    items = spark.range(40_000).select(F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"))
    placed = pack(items).join(items, "item").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).agg(F.max("n"), F.sum("n"), F.count("*"), F.count_if(F.expr("n = m"))).first()
    for low, high in ((1, 2048), (900, 1200), (1025, 1400), (1, 300)):
        items = spark.range(30_000).select(F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(high - low + 1)) + low).alias("length"))
        used = [pack(items, rising=rising).select("sequence_id").distinct().count() for rising in (8, 64, None)]
        assert len(set(used)) == 1, (low, high, used)
    assert placed[0] <= 2048 and placed[2] == placed[3] and placed[2] <= placed[1] / 2048 * 1.002 + 1
    assert best_fit([5, 4, 3, 2], 7)[2] == [7, 7]


def test_url_rules(spark):
    from loomline.llm.op02_url_filters import UrlRule, judge_urls

    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.NET/x?q", "https://www.example.net/en/1", "https://example.net/fr/#f", "ftp://a.b.example.com/de/", "x://badexample.com/de/", "http://o.org/fr/", "http://o.org/fr", "http://c.net:80/", "http://.net/", "http://a..net/z"]
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate([*urls, *urls])], "page_id long, url string, key int, salt string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    many = [*rules, ("b.example.com", "/de/", "allow"), ("example.com", "/", "allow"), ("a..net", "/z", "allow")]

    def brute(url, given):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in given if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    for given in (rules, many):
        for ranges in (1, 5):
            got = judge_urls(pages, [UrlRule(*r) for r in given], ranges=ranges).collect()
            assert Counter(map(tuple, got)) == Counter((i, *brute(u, given)) for i, u in enumerate([*urls, *urls]))
    assert judge_urls(pages.limit(0)).count() == 0
    nameless = judge_urls(pages.select(F.lit(None).cast("long").alias("page_id"), "url")).collect()
    assert Counter(map(tuple, nameless)) == Counter((None, *brute(u, rules)) for u in [*urls, *urls])


def test_toxicity(spark, docs, rows, empty):
    from loomline.llm.boosting import fit_isotonic
    from loomline.llm.op01_toxicity import reject_toxic, toxicity

    r = random.Random(2)
    bad = ["zorgul", "idiot", "blarf"]
    made = []
    for i in range(600):
        w = words(5000 + i, 60).split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(r.randrange(60), r.choice(bad))
        made.append((i, " ".join(w)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(600)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity(table, labels).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (crc32(str(x.doc_id).encode()) % 3 == 1) for x in got) and len(held) > 100
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    assert reject_toxic(table, labels).count() == sum(x.predicted == 0 for x in got)
    odd = toxicity(docs, labels).collect()
    assert len(odd) == len(rows) and all(0 <= x.score <= 1 for x in odd)
    assert all(x.score == 0 for x in toxicity(docs, labels.limit(0)).collect())
    assert toxicity(empty, labels).count() == 0
    knots = fit_isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(knots[1]) >= 0).all() and np.interp(1.5, *knots) == 0.5


def test_language(spark, docs, rows, empty):
    from loomline.llm.op05_language_id import identify

    pools = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "kwaz zrtok brzun plywk".split(), "zz": "uai eou iae ouia".split()}
    r = random.Random(4)
    make = lambda lang, n: " ".join(r.choice(pools[lang]) for _ in range(n))
    made = [(i, make(lang, 50), lang) for i, lang in enumerate(list(pools) * 40)] + [(500, make("xx", 60) + " " + make("yy", 30), None), (501, "12 34", "xx"), (502, None, "xx"), (None, make("zz", 9), None)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in identify(table).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in made[:120])
    assert got[500].lang_pred == "xx" and set(got[500].shares) == {"xx", "yy"} and 0.5 < got[500].score < 0.8
    assert (got[501].lang_pred, got[502].lang_pred, got[502].score, got[None].lang_pred) == ("und", "und", 0.0, "zz")
    assert all(x.held_out == (crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.values() if x.doc_id is not None)
    assert identify(docs).count() == len(rows)
    assert identify(empty).count() == 0 and {x.lang_pred for x in identify(docs, empty).collect()} == {"und"}


def test_boosting_equals_plain_loops():
    """Every node tries every cut of every feature; leaves are Newton steps."""
    from loomline.llm.boosting import fit_boosted

    r = random.Random(8)
    x = [[r.randint(0, 6) + 0.0, r.random(), r.choice([0.0, 1.0])] for _ in range(80)]
    y = [float(a + 3 * b + r.random() > 4.5) for a, b, _ in x]
    edges = [sorted(set(np.quantile([v[j] for v in x], np.linspace(0, 1, 9)[1:-1]).tolist())) for j in range(3)]
    rate0 = sum(y) / len(y)
    margin = [float(np.log(rate0 / (1 - rate0)))] * len(y)
    for _ in range(4):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        nodes = [list(range(len(y)))]
        for _ in range(3):
            following = []
            for rows in nodes:
                g, h = sum(y[k] - p[k] for k in rows), sum(p[k] * (1 - p[k]) for k in rows)
                best = (1e-6, None)
                for j in range(3):
                    for cut in edges[j]:
                        left = [k for k in rows if x[k][j] <= cut]
                        gl, hl = sum(y[k] - p[k] for k in left), sum(p[k] * (1 - p[k]) for k in left)
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        if hl >= 1 and h - hl >= 1 and gain > best[0] + 1e-12:
                            best = (gain, (j, cut))
                j, cut = best[1] or (0, float("inf"))
                following += [[k for k in rows if x[k][j] <= cut], [k for k in rows if x[k][j] > cut]]
            nodes = following
        for rows in nodes:
            step = sum(y[k] - p[k] for k in rows) / (sum(p[k] * (1 - p[k]) for k in rows) + 1)
            for k in rows:
                margin[k] += 0.2 * step
    got = fit_boosted(np.array(x), np.array(y), trees=4, bins=8).margin(np.array(x))
    assert np.allclose(got, margin, atol=1e-9)


def test_isotonic_equals_the_max_min_formula():
    from loomline.llm.boosting import fit_isotonic

    r = np.random.default_rng(5)
    m = np.sort(r.normal(size=60))
    y = (r.random(60) < 1 / (1 + np.exp(-2 * m))).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    at, value = fit_isotonic(m, y)
    assert np.allclose(value, sorted(set(np.round(want, 12))))
    assert (np.diff(at) > 0).all() and len(at) == len(value)


def test_mixture_inference_equals_plain_loops():
    """EM by plain loops, and the penalised likelihood of every set of languages."""
    from itertools import combinations
    from math import log, log2

    from loomline.llm.op05_language_id import PENALTY, LanguageModel, _em

    r = np.random.default_rng(2)
    probs = r.dirichlet(np.full(30, 0.2), size=4).T + 1e-6
    probs /= probs.sum(axis=0)

    def fit(chosen, n):
        theta = [1 / len(chosen)] * len(chosen)
        for _ in range(400):
            new = [0.0] * len(chosen)
            for slot, count in enumerate(n):
                mix = sum(t * probs[slot, c] for t, c in zip(theta, chosen, strict=True))
                for k, c in enumerate(chosen):
                    new[k] += count * theta[k] * probs[slot, c] / mix / sum(n)
            theta = new
        return theta, sum(count * log(sum(t * probs[slot, c] for t, c in zip(theta, chosen, strict=True))) for slot, count in enumerate(n) if count)

    model = LanguageModel(list("abcd"), probs)
    for shares in ([1, 0, 0, 0], [0.6, 0.4, 0, 0], [0.3, 0, 0.3, 0.4], [0, 0, 1, 0]):
        n = r.multinomial(400, probs @ np.array(shares))
        sets = {c: fit(c, n.tolist()) for k in (1, 2, 3, 4) for c in combinations(range(4), k)}
        best = max(sets, key=lambda c: sets[c][1] - PENALTY * log2(1 + n.sum()) * len(c))
        lang, score, found = model.infer(n)
        assert set(found) == {"abcd"[c] for c in best}
        want = dict(zip(["abcd"[c] for c in best], sets[best][0], strict=True))
        assert all(abs(found[k] - want[k]) < 0.02 for k in found) and lang == max(want, key=want.get) and abs(score - want[lang]) < 0.02
        theta, like = _em(probs[:, list(best)], n.astype(float), np.full(len(best), 1 / len(best)), rounds=400)
        assert abs(like - sets[best][1]) < 0.05


def test_language_sample_leaves_no_rare_language_out(spark):
    from loomline.llm.op05_language_id import fit_languages

    made = [(i, "aba cdc " * 5, "common") for i in range(3000)] + [(5000 + i, "xyz zyx " * 5, "rare") for i in range(3)]
    model = fit_languages(spark.createDataFrame(made, "doc_id long, text string, lang string"), F.lit(True), max_rows=40)
    assert model.langs == ["common", "rare"]


def test_mixing_draws(spark):
    """Quotas are met exactly, blocks are used evenly, and shards draw as a multinomial does."""
    from loomline.llm.op04_mixing import MixSettings, drawn_blocks

    quotas = {0: (3000, 70), 1: (6000, 4000), 2: (999, 333)}
    table = spark.createDataFrame([(s, q, b) for s, (q, b) in quotas.items()], "sid int, quota long, blocks long")
    got = drawn_blocks(spark, table, MixSettings(shard_slots=100), 5).collect()
    assert len(got) == len({r.slot for r in got}) == 9999 and Counter(r.sid for r in got) == {s: q for s, (q, _) in quotas.items()}
    uses = Counter((r.sid, r.block) for r in got)
    for s, (q, b) in quotas.items():
        counts = [uses[s, k] for k in range(b)]
        assert sum(counts) == q and min(counts) >= q // b and max(counts) <= -(-q // b)
    shards = defaultdict(Counter)
    for r in got:
        shards[r.shard][r.sid] += 1
    full = [c for c in shards.values() if sum(c.values()) == 100]
    assert len(full) == 99
    for s, (q, _) in quotas.items():
        share = q / 9999
        seen = np.var([c[s] for c in full])
        assert 0.5 < seen / (100 * share * (1 - share)) < 1.7, s  # a fixed count for each shard would have none


def test_pipeline_rows(spark, tmp_path):
    """What each stage does to planted documents, and the packing of the rows that are left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    r, bad = random.Random(9), ["zorgul", "blarfed", "idiot"]
    texts, toxic = {}, {}
    for i in range(400):
        w = words(40_000 + i, r.randint(30, 250)).split()
        toxic[i] = int(i % 5 == 0)
        for k in r.sample(range(len(w)), 5):
            w[k] = r.choice(bad) + "." if toxic[i] else w[k] + "."
        texts[i] = " ".join(w)
    passage = ". ".join(words(50_000 + i, 12) for i in range(5)) + "."
    texts[401] = "Some lines of its own here. " + passage
    texts[402] = "Other lines stand here. " + passage + " And after it more."
    near = words(51_000, 200)
    texts[403], texts[404] = near, near.replace(near.split()[90], "changed", 1)
    texts[405] = None
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = current.collect()
    left = {x.doc_id: x.text for x in kept["toxicity"]}
    assert sum(toxic[i] for i in left if i in toxic) <= 4 and sum(1 - t for i, t in toxic.items() if i in left) >= 316 and {401, 402, 403, 404, 405} <= set(left)
    lines = {x.doc_id: x.text for x in kept["line_dedup"]}
    assert lines[401] == texts[401] and lines[402] == "Other lines stand here. And after it more." and set(lines) == set(left)
    alone = {x.doc_id for x in kept["near_dedup"]}
    assert 403 in alone and alone == set(lines) - {404}
    sizes, taken = Counter(), Counter()
    for x in kept["near_dedup"]:
        sizes[x.source] += len((x.text or "").split())
    for x in kept["mixing"]:
        taken[x.source] += len((x.text or "").split())
    total = sum(sizes.values())
    assert abs(taken["a"] - total / 3) <= 200 and abs(taken["b"] - total * 2 / 3) <= 200
    plain = Tokenizer.from_file(path)
    want = Counter((x.doc_id, len(plain.encode(x.text or "", add_special_tokens=False).ids) + 1) for x in kept["mixing"])
    assert Counter((x.doc_id, x.length) for x in kept["packing"]) == want  # none is long enough to be cut
    fills = Counter()
    for x in kept["packing"]:
        fills[x.sequence_id] += x.length
    assert max(fills.values()) <= 2048 and len(fills) <= -(-sum(fills.values()) // 2048) + 1


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    empty.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == corpus_pipeline.COLUMNS, name
        path = f"{tmp_path}/out-{name}"
        current.write.parquet(path)
        current = spark.read.parquet(path)
    # a second call of a stage leaves the first result readable, and the whole pipeline that of other queries
    from loomline.llm.op03_exact_dedup import exact_groups

    first, second = (corpus_pipeline.near_dedup(spark, docs, str(tmp_path)) for _ in range(2))
    assert first.count() == second.count() > 0
    other = exact_groups(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert other.count() == docs.count()


def test_row_keys_tell_null_columns_apart(spark):
    from loomline.llm.common import row_key

    rows = [(None, "x", None), (None, None, "x"), ("x", None, None), (None, None, None), ("", None, None)]
    made = spark.createDataFrame(rows, "a string, b string, c string").select(*row_key("a", "b", "c"))
    assert made.distinct().count() == made.select("key_a").distinct().count() == len(rows)


def test_registry_matches_entry(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
