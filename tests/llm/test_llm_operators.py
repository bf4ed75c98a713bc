"""The operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from auditlake.llm import decontaminate, exact_dedup, html_labeller, language, line_dedup, mixing, near_dedup, quality, revisits, substring_dedup

DOCS = "doc_id long, text string, lang string, source string"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split(" ")
    for k in rng.sample(range(len(w)), n):
        w[k] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark):
    passage, base = words(70, 1), words(300, 2)
    texts = [None, "", " ", None, "One two THREE", "one TWO three", "É é", "é é", base, base.upper(), passage]
    texts += [f"{words(30, 10 + k)} {passage} {words(20, 50 + k)}" for k in range(6)]
    texts += [edited(base, k, k) for k in (1, 2, 3, 5, 8, 20, 60)]
    texts += [words(20_000, 77), "word " * 500, "a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb\nc\na\nb\nc", "\n\n\n\n", "tab\there\x0bvt\xa0nbsp"]
    rows = [(k, t, "en", f"s{k % 5}" if k % 7 else None) for k, t in enumerate(texts)]
    rows += [rows[8], rows[11], (None, "no id", None, None), (None, base, None, "s1")]
    return spark.createDataFrame(rows, DOCS)


def with_extras(df):
    """Columns with the names that operators use themselves."""
    names = ["key", "row", "group", "size", "n", "_d", "_k", "bucket", "label", "rest", "copies", "rate", "target", "_id"]
    return df.withColumns({n: F.lit("mine") for n in names})


def collected(df):
    return [r.asDict() for r in df.collect()]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def test_exact_groups_against_brute_force(docs):
    rows = collected(docs)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lowered(r["text"])].append(r["doc_id"])
    for df in (docs, with_extras(docs)):
        got = collected(exact_dedup.exact_groups(df))
        assert len(got) == len(rows)
        want = collections.Counter((r["doc_id"], max((i for i in groups[lowered(r["text"])] if i is not None), default=None), len(groups[lowered(r["text"])]), hashlib.sha256(lowered(r["text"]).encode()).hexdigest()) for r in rows)
        assert collections.Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
        assert sum(g["kept"] for g in got) == len(groups)
    for df in (docs, docs.dropDuplicates(["doc_id", "text"])):  # with and without repeated rows
        left = collected(exact_dedup.drop_exact_copies(with_extras(df)))
        assert len(left) == len(groups) and len({lowered(r["text"]) for r in left}) == len(groups)
        assert {r["doc_id"] for r in left} == {max((i for i in g if i is not None), default=None) for g in groups.values()}


def test_exact_groups_compare_bytes_beyond_each_digit(spark):
    long = "q" * 5000
    rows = [(k, t, None, None) for k, t in enumerate([long, long + "a", long + "b", long, long[:-1], "q" * 128, "q" * 129, "q" * 2176, "q" * 2177])]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in collected(exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)))}
    assert got == {k: (k, 1) for k in (1, 2, 4, 5, 6, 7, 8)} | {0: (3, 2), 3: (3, 2)}


def brute_parse(rows, n=50):
    """doc_id, words, factors and kept text, by a greedy parse that compares words: the reference holds first places only."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    ids = [r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1 for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (ids[k], rows[k]["_key"]))
    first = {}
    for k in order:
        for at in range(len(split[k]) - n + 1):
            first.setdefault(tuple(split[k][at : at + n]), (ids[k], rows[k]["_key"], at, k))
    out = []
    for k, r in enumerate(rows):
        w, factors, at = split[k], [], 0
        while at + n <= len(w):
            block, key, offset, ref = first[tuple(w[at : at + n])]
            if block >= ids[k]:
                at += 1
                continue
            length = n
            while at + length < len(w) and offset + length < len(split[ref]) and w[at + length] == split[ref][offset + length]:
                if first[tuple(w[at + length - n + 1 : at + length + 1])][:3] != (block, key, offset + length - n + 1):
                    break  # the block does not hold that window, as it occurs before
                length += 1
            factors.append((at, length, block, offset))
            at += length - n + 1  # the windows astride the factor's end are next
        gone = {p for start, length, _, _ in factors for p in range(start, start + length)}
        out.append((r["doc_id"], len(w), tuple(factors), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return collections.Counter(out)


def parsed(df):
    """What the operator gives for `df`, and what brute force does."""
    got = substring_dedup.remove_repeats(df).withColumn("gone", substring_dedup.n_removed(F.col("spans")))
    got = collections.Counter((r["doc_id"], r["n_words"], tuple((f["start"], f["length"], f["block"], f["offset"]) for f in r["factors"]), r["gone"], r["kept_text"]) for r in collected(got))
    return got, brute_parse(collected(df.withColumn("_key", F.xxhash64("text"))))


def test_factors_against_brute_force(docs):
    for df in (docs, with_extras(docs)):
        got, want = parsed(df)
        assert got == want and any(f for _, _, f, _, _ in got)


def test_factors_of_passages_at_all_offsets(spark):
    passage = words(120, 5)
    w = passage.split()
    rows = [(0, passage, None, None)] + [(k + 1, " ".join([*words(k % 9, k).split(), *w[k : k + 40 + k], *words(7, 99 + k).split()]), None, None) for k in range(40)]
    got, want = parsed(spark.createDataFrame(rows, DOCS))
    assert got == want


def test_factors_of_chained_overlapping_copies(spark):
    """Each text is made of stretches of the ones before: windows of one phrase lie in several blocks, phrases share anchors."""
    rng, texts = random.Random(12), [words(300, 41, 10**6).split()]
    for k in range(60):
        t = []
        while len(t) < 260:
            own = rng.choice(texts)
            at = rng.randrange(max(1, len(own) - 60))
            t += own[at : at + rng.randrange(20, 110)] if rng.random() < 0.8 else words(rng.randrange(1, 20), 7000 + 60 * k + len(t)).split()
        texts.append(t)
    rows = [(k, " ".join(t), None, None) for k, t in enumerate(texts)] + [((1 << 63) - 1, " ".join(texts[5]), None, None), (None, " ".join(texts[6]), None, None), (7, " ".join(texts[30]), None, None)]
    got, want = parsed(spark.createDataFrame(rows, DOCS).repartition(5))
    assert got == want
    assert any(a[0] + a[1] > b[0] for _, _, f, _, _ in got for a, b in zip(f, f[1:]))  # factors that overlap at their boundary


def bag(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    same = sum((a & b).values())
    return same / (sum(a.values()) + sum(b.values()) - same)


def brute_classes(rows):
    bags, root = [bag(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(k)
    return {frozenset(v) for v in classes.values()}


def test_near_duplicates_against_brute_force(docs):
    rows = collected(docs)
    got = collected(near_dedup.near_duplicates(with_extras(docs)))
    assert len(got) == len(rows)
    sizes = collections.Counter(len(c) for c in brute_classes(rows) for _ in c)
    assert collections.Counter(g["class_size"] for g in got) == sizes
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    for c in brute_classes(rows):
        ids = [rows[k]["doc_id"] for k in c]
        known = [i for i in ids if i is not None]
        assert all(by[i] == min(known) for i in known)
    assert len(collected(near_dedup.drop_near_copies(docs))) == len(brute_classes(rows))


def test_near_duplicates_of_a_group_without_its_origin(spark):
    """Copies of one text with few to many changes: only chains of close ones are a class."""
    base = words(200, 3, 10**6)
    rows = [(k, edited(base, 1 + k % 12, 1000 + k), None, None) for k in range(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = collections.defaultdict(set)
    for r in collected(near_dedup.near_duplicates(df)):
        got[r["class_id"]].add(r["doc_id"])
    assert set(map(frozenset, got.values())) == brute_classes([{"text": t} for _, t, _, _ in rows])


def test_near_duplicates_of_a_template_with_slots(spark):
    """Texts of one template that vary in 12 places: nearly all share buckets, few are linked, and few pairs leave the prefix join."""
    rng, base = random.Random(21), words(200, 22, 10**6).split()
    rows = []
    for k in range(300):
        w = list(base)
        for slot in range(12):
            w[8 + 16 * slot] = f"s{slot}v{rng.randrange(3)}"
        rows.append((k, " ".join(w), None, None))
    got, pairs = collections.defaultdict(set), []
    keep = near_dedup._remaining

    def counted(*args):
        out = keep(*args)
        pairs.append(out.count())
        return out

    near_dedup._remaining = counted
    try:
        for r in collected(near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5))):
            got[r["class_id"]].add(r["doc_id"])
    finally:
        near_dedup._remaining = keep
    assert set(map(frozenset, got.values())) == brute_classes([{"text": t} for _, t, _, _ in rows])
    assert sum(pairs) < 300 * 299 / 2 / 8  # of all pairs


def test_near_duplicates_of_long_template_texts(spark):
    """Bags of 2,000 shingles, whose sketches are full, are told apart all the same."""
    rng, base = random.Random(31), words(2000, 32, 10**6).split()
    rows = [(k, " ".join(f"v{k}x{j}" if rng.random() < 0.01 * (k % 7) else x for j, x in enumerate(base)), None, None) for k in range(40)]
    got = collections.defaultdict(set)
    for r in collected(near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS))):
        got[r["class_id"]].add(r["doc_id"])
    assert set(map(frozenset, got.values())) == brute_classes([{"text": t} for _, t, _, _ in rows])


def test_every_link_of_the_documents_is_in_a_class(spark):
    """All documents of sf 0.01 against those whose id is divisible by 100: linked texts are in one class, all of them."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    rows = [r for r in collected(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))]
    bags = {r["doc_id"]: bag(r["text"]) for r in rows}
    by = {r["doc_id"]: r["class_id"] for r in collected(near_dedup.op7_near_dedup(spark, sf))}
    links = [(q, i) for q in bags if q % 100 == 0 for i in bags if i != q and bags[q] and bags[i] and jaccard(bags[q], bags[i]) >= 0.8]
    assert len(by) == len(rows) and all(by[q] == by[i] for q, i in links)


def test_signatures_estimate_weighted_jaccard():
    import pyarrow as pa

    from auditlake.llm._words import slices

    a = words(300, 4, 60)
    texts = [a, a + " " + words(100, 6, 60), "b b b b b b " * 40, "b b b b b b " * 60]
    (s,) = slices(pa.array(texts))
    text, h, count = near_dedup.bags(s, 5)
    sig = near_dedup.bag_minhash(text, h, count, 4, 4096)
    for x, y in ((0, 1), (2, 3)):
        assert abs((sig[x] == sig[y]).mean() - jaccard(bag(texts[x]), bag(texts[y]))) < 0.04


def item_windows(t, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    return w, [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


def brute_contamination(rows, items):
    windows = [(i, set(item_windows(t, 8)[1])) for i, t in items]
    out = []
    for r in rows:
        w, _ = item_windows(r["text"], 8)
        hit, found = set(), set()
        for i, ws in windows:
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        found |= {str(i)} if i is not None else set()
        out.append((r["doc_id"], len(w), len(hit), tuple(sorted(found))))
    return collections.Counter(out)


def test_contamination_against_brute_force(spark, docs):
    rows = collected(docs)
    w = rows[8]["text"].split()
    items = [(1, " ".join(w[10:30])), (2, "ONE, two; three!"), (10, " ".join(w[15:40])), (3, None), (None, "one two three"), (None, " ".join(w[250:262])), (4, "..."), (5, " ".join(w[200:208])), (5, "word word word word word word word word word"), (6, words(30, 999))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    for block_words in (10**6, 12):
        got = decontaminate.find_contamination(with_extras(docs), bench, block_words=block_words)
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in collected(got)) == want
    left = collected(decontaminate.decontaminate(docs, bench))
    for r in left:
        assert not set(item_windows(r["text"], 8)[1]) & set(item_windows(" ".join(w[10:30]), 8)[1])
    clean = {d for d, _, n, _ in want if n == 0}
    assert clean <= {r["doc_id"] for r in left}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in collected(decontaminate.find_contamination(docs, empty)))


def test_line_windows_against_brute_force(docs):
    rows = collected(docs)
    places = collections.defaultdict(set)
    # rows that agree in id and text are one place; a null id is the last
    for r in {(r["doc_id"], r["text"]): r for r in rows}.values():
        lines = (r["text"] or "").split("\n")
        for k in range(len(lines) - 2):
            places[tuple(lines[k : k + 3])].add((r["doc_id"] is None, r["doc_id"] or 0, r["text"], k))
    want = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        gone = {k + j for k in range(len(lines) - 2) if min(places[tuple(lines[k : k + 3])]) != (r["doc_id"] is None, r["doc_id"] or 0, r["text"], k) for j in range(3)}
        want.append((r["doc_id"], len(lines), len(gone), r["text"] if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    got = collected(line_dedup.dedup_lines(with_extras(docs)))
    assert collections.Counter((g["doc_id"], g["n_lines"], g["n_removed"], g["text"]) for g in got) == collections.Counter(want)


def test_lines_of_very_long_texts(spark):
    """Hundreds of thousands of lines, all repeated: what stays is found by number, not by search."""
    t = "\n".join(f"line {k}" for k in range(300_000))
    df = spark.createDataFrame([(1, t, None, None), (2, t, None, None), (3, f"first\n{t}\nlast", None, None)], DOCS)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in collected(line_dedup.dedup_lines(df))}
    assert got == {1: (300_000, 0, t), 2: (300_000, 300_000, ""), 3: (300_002, 300_000, "first\nlast")}


def test_line_dedup_plan_has_no_python(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(k, words(rng.randrange(1, 60), k), None, rng.choice(["a", "b", "c", "d", None])) for k in range(4000)] + [(None, None, None, "a"), (100_000, "", None, "zz")]
    df = spark.createDataFrame(rows, DOCS)
    got = collected(mixing.plan_mix(with_extras(df)))
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    order = [s for s in sorted((s for s in size if s is not None))] + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    by = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for g in got:
        if g["doc_id"] is not None:
            s = by[g["doc_id"]]
            assert abs(g["target"] - target[s]) < 1e-6 * max(1, target[s]) and g["copies"] <= 2
            taken[s] += g["size"] * g["copies"]
    assert all(abs(taken[s] - target[s]) < 0.08 * target[s] + 1 for s in order)
    mixed = mixing.mix(with_extras(df))
    assert mixed.columns == with_extras(df).columns and mixed.count() == sum(g["copies"] for g in got)
    assert sorted(map(str, collected(mixing.plan_mix(df)))) == sorted(map(str, collected(mixing.plan_mix(df.repartition(3)))))


@pytest.mark.parametrize("run", [
    lambda d, b: exact_dedup.exact_groups(d), lambda d, b: exact_dedup.drop_exact_copies(d), lambda d, b: substring_dedup.remove_repeats(d), lambda d, b: near_dedup.near_duplicates(d), lambda d, b: near_dedup.drop_near_copies(d),
    lambda d, b: line_dedup.dedup_lines(d), lambda d, b: mixing.plan_mix(d), lambda d, b: mixing.mix(d), lambda d, b: decontaminate.find_contamination(d, b), lambda d, b: decontaminate.decontaminate(d, b),
    lambda d, b: quality.keep_good(d, b.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("quality"))), lambda d, b: language.identify_language(d, language.fit_on(d)),
])
def test_empty_tables_give_empty_results(spark, run):
    assert run(spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_quality_model_tells_kinds_apart(spark):
    rng = random.Random(3)
    good = [(k, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "slept", "well"]) for _ in range(60)) + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "CLICK", "###", "WIN"]) for _ in range(60))) for k in range(300)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in good + bad] + [(5000, None, None, None), (5001, "", None, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(df, labels)
    got = {r["doc_id"]: r["score"] for r in collected(quality.score_quality(with_extras(df).drop("key"), model))}
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] == 0
    assert sum(got[i] >= 0.7 for i, _ in good) >= 297 and sum(got[i] < 0.7 for i, _ in bad) >= 297
    assert got == {r["doc_id"]: r["score"] for r in collected(quality.score_quality(df, quality.fit_on(df, labels)))}
    kept = quality.keep_good(with_extras(df), labels)
    assert kept.columns == with_extras(df).columns and {r["doc_id"] for r in collected(kept)} == {i for i, s in got.items() if s >= 0.7}
    flat = quality.fit([(1, "only good"), (1, "texts here")])
    assert quality.score_texts(flat, [b"anything", b""]).tolist() == [1.0, 0.0]


def test_language_models_on_held_out_texts(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "ri", "to", "mu", "sha"], "bb": ["ent", "ung", "sch", "er", "ich"], "cc": ["eau", "oi", "lé", "ment", "que"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang := ["aa", "bb", "cc"][k % 3], rng.randrange(1, 80)), lang, None) for k in range(600)]
    df = spark.createDataFrame([*rows, (9000, None, "aa", None), (9001, "12 34 !?", None, None), (9002, "", None, None), (None, "ungschich", None, None)], DOCS)
    got = {r["doc_id"]: r for r in collected(language.identify_language(df, language.fit_on(df)))}
    assert [got[k]["lang_pred"] for k in (9000, 9001, 9002)] == ["und"] * 3
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in rows) >= 590 and got[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.fit([]).predict(["abc"])[0] == ["und"]


def corpus(spark, path, rows, labels=()):
    """documents and labels as the queries read them."""
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_query_on_held_out_rows(spark, tmp_path):
    rng = random.Random(5)
    good = lambda n: " ".join(rng.choice(["river", "stone", "walks", "under", "bright", "sky", "and", "the", "slowly", "home"]) for _ in range(n)) + "."
    bad = lambda n: " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "click", "###", "WIN"]) for _ in range(n))
    rows = [(k, (bad if k % 3 == 0 else good)(rng.randrange(5, 80)), "en") for k in range(900)]
    rows += [(5000, None, None), (5001, "", None), (5002, good(60_000), "en"), (3, "a second row of that id", None)]
    labels = [(k, int(k % 3 != 0)) for k in range(900)] + [(5002, 1), (77, None)]
    sf = corpus(spark, tmp_path / "a", rows, labels)
    got = collected(quality.op3_quality(spark, sf))
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held) > 100
    assert {r["score"] for r in got if r["doc_id"] in (5000, 5001)} == {0.0}
    # neither the labels of held-out rows nor their texts are learned from
    other = [(i, 1 - q if fold(i, 4) == 2 and q is not None else q) for i, q in labels]
    again = corpus(spark, tmp_path / "b", [(i, t if fold(i, 4) != 2 else "x", None) for i, t, _ in rows], other)
    same = {r["doc_id"]: r["score"] for r in collected(quality.op3_quality(spark, again)) if not r["held_out"] and r["doc_id"] != 3}
    assert same == {r["doc_id"]: r["score"] for r in got if not r["held_out"] and r["doc_id"] != 3}


def test_quality_curve_and_differences_against_plain_compression():
    import zstandard

    rng = random.Random(6)
    good, bad = ([" ".join(rng.choice(v) for _ in range(60)) for _ in range(80)] for v in (["lamp", "field", "quiet", "morning"], ["zzz", "!!", "spam", "777"]))
    model = quality.fit([(1, t) for t in good] + [(0, t) for t in bad])
    for text in (good[3], bad[4], good[5] + bad[6] * 3, "x"):
        raw, size = text.encode(), []
        for d in model.dictionaries:
            z = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append(sum(len(z.compress(raw[i : i + quality.BLOCK_BYTES])) for i in range(0, len(raw), quality.BLOCK_BYTES)))
        assert abs(quality.differences(model.dictionaries, [raw])[0] - (size[1] - size[0]) / len(raw)) < 1e-12
    x = quality.differences(model.dictionaries, [t.encode() for t in good + bad])
    score = quality.score_texts(model, [t.encode() for t in good + bad])
    assert (score[x.argsort()][1:] >= score[x.argsort()][:-1]).all()


def test_quality_with_few_labels(spark):
    rows = [(1, "one good text", None, None), (2, "BAD BAD", None, None), (3, None, None, None), (4, "good " * 40_000, None, None)]
    df, label = spark.createDataFrame(rows, DOCS), "doc_id long, quality int"
    for labels in ([], [(1, 1)], [(99, 0), (1, 1)], [(3, 0), (1, 1)]):  # none, one class, one of an unknown document, one of a null text
        kept = quality.keep_good(df, spark.createDataFrame(labels, label))
        assert sorted(r["doc_id"] for r in collected(kept)) == [1, 2, 3, 4]
    model = quality.fit_on(df, spark.createDataFrame([(1, 1), (2, 0)], label))
    assert model.dictionaries and all(0 <= r["score"] <= 1 for r in collected(quality.score_quality(df, model)))


def test_samples_are_bounded_and_leave_no_label_out(spark):
    from auditlake.llm._sample import sample_texts

    long = "".join(chr(97 + k % 26) for k in range(200_000))
    rows = [(k, f"text {k}", "a", None) for k in range(300)] + [(1000, long, "b", None), (1000, long, "b", None), (1001, None, "c", None), (1002, " ", "c", None), (None, "x", "a", None)] + [(2000 + k, "rare", f"r{k}", None) for k in range(5)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sample_texts(df, df.select("doc_id", F.col("lang").alias("label")), 40, 1000)
    assert got == sample_texts(df.repartition(2), df.select("doc_id", F.col("lang").alias("label")), 40, 1000)
    by = collections.Counter(label for label, _ in got)
    assert 35 <= by["a"] <= 40 and by["b"] == 1 and "c" not in by and len(by) == 7
    (piece,) = [t for label, t in got if label == "b"]
    assert len(piece) == 1000 and piece in long
    assert {label for label, _ in sample_texts(df, df.select("doc_id", F.col("lang").alias("label")), 40, 1000, labels=1)} == {"a"}


def test_language_query_on_held_out_rows(spark, tmp_path):
    rng = random.Random(7)
    parts = {"aa": ["ka", "ri", "to", "mu", "sha"], "bb": ["ent", "ung", "sch", "er", "ich"], "cc": ["eau", "oi", "lé", "ment", "que"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang := ["aa", "bb", "cc"][k % 3], rng.randrange(3, 80)), lang) for k in range(900)]
    rows += [(5000, None, "aa"), (5001, "12 34 !?", None), (5002, text("bb", 40_000), "bb"), (5003, text("cc", 30), None)]
    got = {r["doc_id"]: r for r in collected(language.op8_language(spark, corpus(spark, tmp_path / "a", rows)))}
    assert len(got) == len(rows) and all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in range(900) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == ["aa", "bb", "cc"][i % 3] for i in held) >= 0.98 * len(held) > 200
    assert [got[k]["lang_pred"] for k in (5000, 5001, 5002, 5003)] == ["und", "und", "bb", "cc"]
    # held-out rows are not learned from, and lang is no input of a prediction
    again = corpus(spark, tmp_path / "b", [(i, t, None if fold(i, 3) == 1 else lang) for i, t, lang in rows])
    assert {i: (r["lang_pred"], r["score"]) for i, r in got.items()} == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in collected(language.op8_language(spark, again))}


def test_language_scores_reject_what_was_not_learned():
    rng = random.Random(9)
    parts = {"aa": ["ka", "ri", "to", "mu", "sha"], "bb": ["ent", "ung", "sch", "er", "ich"], "cc": ["eau", "oi", "lé", "ment", "que"], "dd": ["ost", "fra", "wik", "hel"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    model = language.fit([(lang, text(lang, rng.randrange(5, 60))) for lang in ("aa", "bb", "cc") for _ in range(120)])
    known = [(lang, text(lang, rng.randrange(5, 60))) for lang in ("aa", "bb", "cc") for _ in range(100)]
    lang, score, rejected = model.predict([t for _, t in known])
    right = sum(x == y for x, (y, _) in zip(lang, known))
    assert right >= 297 and abs(score.mean() - right / 300) < 0.05 and rejected.sum() <= 6
    odd = [text("dd", 30) for _ in range(50)] + ["Это предложение написано на русском языке", "これは日本語の文章です"] + ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(60)) for _ in range(50)]
    _, score, rejected = model.predict(odd)
    assert rejected.mean() > 0.95 and score.mean() < 0.1


def test_kneser_ney_against_brute_force():
    import math

    rng, order = random.Random(10), 3
    train = ["".join(rng.choice("abcd  ") for _ in range(60)) for _ in range(6)]
    codes, places, _ = language.encode(train, order)
    alphabet = 9
    model = language.KneserNey(codes, places, order, alphabet)
    grams = [collections.Counter() for _ in range(order + 1)]
    for p in places.tolist():
        grams[order][tuple(codes[p - order + 1 : p + 1].tolist())] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discount = [0.0] * (order + 1)
    for n in range(1, order + 1):
        one, two = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        discount[n] = min(max(one / max(one + 2 * two, 1), 0.1), 0.95)

    def probability(g):
        p = 1 / alphabet
        for n in range(1, order + 1):
            own = {k: c for k, c in grams[n].items() if k[:-1] == g[len(g) - n : -1]}
            if own:
                p = (max(own.get(g[len(g) - n :], 0) - discount[n], 0) + discount[n] * len(own) * p) / sum(own.values())
        return p

    test_codes, test_places, _ = language.encode(["abca dab", "xyz abd"], order)
    got = model.probability([language.gram(test_codes, test_places, n + 1) for n in range(order)], [language.gram(test_codes, test_places - 1, n) for n in range(order)])
    want = [probability(tuple(test_codes[p - order + 1 : p + 1].tolist())) for p in test_places.tolist()]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got.tolist(), want, strict=True))


def test_kneser_ney_probabilities_sum_to_one():
    import numpy as np

    codes, places, _ = language.encode(["abab abc bca", "cab"], 3)
    letters = np.unique(codes)
    m = language.KneserNey(codes, places, 3, len(letters))
    for at in (places[4], places[7]):
        total = 0.0
        for c in letters:
            trial = codes.copy()
            trial[at] = c
            a = np.array([at])
            total += m.probability([language.gram(trial, a, n + 1) for n in range(3)], [language.gram(trial, a - 1, n) for n in range(3)])[0]
        assert abs(total - 1) < 1e-6


PAGE = """<html><head><title>t</title><script>var x = "</p>";</script></head><body><header class="site-header"><div>Brand name</div></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>The   title &amp; more</h1><p>First paragraph of some length, with words enough to be one.<p><b>Second paragraph<br>goes on and on, &eacute; and so does this text.</p><p>Short.</p></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked what I have read here a lot.</p></div></div><footer>&copy; 2024 someone</footer></body></html>"""


def test_html_blocks_and_main_text(spark):
    cut = [b.text for b in html_labeller.blocks(PAGE)]
    assert "The title & more" in cut and "Second paragraph goes on and on, é and so does this text." in cut and not any("var x" in t for t in cut)
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p></p>"), (5, "x", "<ul><li>" * 3000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in collected(html_labeller.extract_main_text(df.withColumn("n", F.lit("mine"))))}
    assert got[1]["text"] == "The title & more\n\nFirst paragraph of some length, with words enough to be one.\n\nSecond paragraph goes on and on, é and so does this text.\n\nShort."
    assert got[1]["n_chars"] == len(got[1]["text"]) and [got[k]["text"] for k in (2, 3, 4, 5)] == [""] * 4


def test_labeller_on_held_out_layouts():
    import numpy as np

    def share_right(net):
        rng, right, total = np.random.default_rng(123), 0, 0
        for _ in range(80):
            page, y = html_labeller.training_page(rng)
            b = html_labeller.blocks(page)
            if len(b) == len(y) and y:
                z = html_labeller.label_blocks(net, [b])[0]
                right, total = right + (z == np.array(y, bool)).sum(), total + len(y)
        return right / total

    assert share_right(html_labeller.trained()) > 0.97
    assert share_right(html_labeller.train(pages=200, epochs=8)) > 0.9


#: Layouts that the generator of training pages does not make, in the manner of hand-written sites: html, main text.
OTHER_LAYOUTS = [
    (
        """<!DOCTYPE html><html><body><table width=100%><tr><td colspan=2><font size=5>The River Gazette</font></td></tr><tr><td valign=top><a href=/>Front page</a><br><a href=/arch>Archive</a><br><a href=/c>Contact</a></td>
        <td><h2>Bridge opens after two years</h2><p>The old stone bridge was opened again on Monday, after repairs that took two years and cost the town more than had been planned.</p>
        <p>Shop owners on both banks said that they had waited long for this day, and that trade would now come back.</p></td></tr><tr><td colspan=2><font size=1>Copyright The River Gazette</font></td></tr></table></body></html>""",
        ["Bridge opens after two years", "The old stone bridge was opened", "Shop owners on both banks"], ["Front page", "Archive", "Copyright"],
    ),
    (
        """<html><body><div id="top"><a href="/">Home</a> <a href="/shop">Shop</a> <a href="/help">Help</a></div><div id="main"><div class="post"><h1>How to store apples</h1><p>Keep them cool and dark, and never beside potatoes, as both will spoil sooner than they would alone.</p>
        <ul><li>Look through them every week.</li><li>Take out those with spots, before the others catch it.</li></ul></div><div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten soups</a></li><li><a href="/2">Best knives</a></li></ul></div></div>
        <div class="cookie-banner">We use cookies to make this site work better for you.</div><div id="footer">Terms | Privacy</div></body></html>""",
        ["How to store apples", "Keep them cool and dark", "Look through them every week.", "Take out those with spots"], ["Ten soups", "cookies", "Terms"],
    ),
]


def test_main_text_of_other_layouts():
    for page, wanted, other in OTHER_LAYOUTS:
        (text,) = html_labeller.main_texts(html_labeller.trained(), [page])
        assert [w for w in wanted if w in text] == wanted and not [o for o in other if o in text]


def test_blocks_take_time_and_memory_in_proportion():
    import time

    pages = {"open": "<a " * 800_000, "deep": "<div>x" * 100_000, "marks": "<" * 1_000_000, "closers": "<div>" * 50_000 + "</b>" * 100_000, "cells": "<p><table>" + "<i>" * 50_000 + "</p>" * 50_000, "quotes": "<a href='" * 200_000, "comments": "<!--" * 500_000}
    began = time.process_time()
    count = {k: len(html_labeller.blocks(v)) for k, v in pages.items()}
    assert time.process_time() - began < 60  # quadratic time takes hours
    assert count == {"open": 0, "deep": 100_000, "marks": 1, "closers": 0, "cells": 0, "quotes": 0, "comments": 0}


def test_blocks_of_odd_marks():
    cut = lambda page: [b.text for b in html_labeller.blocks(page)]
    assert cut('<p>a < b &lt; c</p x><!-- > --><p title="1 > 0">d<?php x ?>e</p><p>f</P ><p>g<a href=h') == ["a < b < c", "de", "f", "g"]
    assert cut("<table><tr><td>a<td>b<tr><th>c</table><ul><li>d<li>e</ul><p>f</td>g</p><script>'</p>'</script >h") == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert cut("<td>a</p>b<p>c<table><td>d</p>e</table>f") == ["a", "b", "c", "d", "e", "f"]


def test_lstm_gradient_against_differences():
    import numpy as np

    rng, net = np.random.default_rng(0), html_labeller.Labeller(1)
    net.p = [q.astype(np.float64) for q in net.p]
    x, mask = rng.normal(size=(4, 3, html_labeller.INPUT)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = (rng.random((4, 3)) < 0.5).astype(float)
    _, grads = net.gradient(x, mask, y)
    for k, q in enumerate(net.p):
        at = tuple(0 for _ in q.shape)
        old, h = q[at], 1e-4
        q[at] = old + h
        up = net.gradient(x, mask, y)[0]
        q[at] = old - h
        down = net.gradient(x, mask, y)[0]
        q[at] = old
        assert abs((up - down) / (2 * h) - grads[k][at]) < 1e-4


CAPTURE = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, digest string"


def brute_revisits(rows):
    def canonical(u):
        u = re.sub(r"#.*$", "", u.strip())
        m = re.match(r"(?i)https?://(?:www\.)?([^/?]*)(.*)$", u)
        if not m:
            return re.sub("/$", "", u) or None
        host, rest = re.sub(":(80|443)$", "", m[1].lower()), m[2]
        return (host + re.sub("/$", "", rest)) or None

    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        url = canonical(r[1]) if r[1] else None
        earlier = [x for x in rows if x[3] == "response" and x[4] == 200 and x[1] and url and canonical(x[1]) == url and r[2] is not None and x[2] is not None and x[2] < r[2]]
        best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        bare = lambda e: re.sub("^W/", "", e) if e else e
        if best is None:
            state = "orphan"
        elif r[5] is not None:
            state = "resolved" if bare(r[5]) == bare(best[5]) else "mismatch"
        elif r[6] is not None:
            state = "resolved" if r[6] == best[6] else "mismatch"
        else:
            state = "unvalidated"
        good = state in ("resolved", "unvalidated")
        merged = None
        if good:
            fresh = {k: v for k, v in (r[7] or {}).items() if k.lower() in revisits.PERMITTED}
            merged = {k: v for k, v in (best[7] or {}).items() if k.lower() not in {f.lower() for f in fresh}} | fresh
        out.append((r[0], url, r[2], best[0] if good else None, state, tuple(sorted(merged.items())) if good else None, best[8] if good else None))
    return collections.Counter(out)


def test_revisits_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        hot = rng.random() < 0.5
        url = rng.choice(["http://www.Hot.example/", "https://hot.example", "https://hot.example:443/#x"]) if hot else f"https://s{rng.randrange(12)}.example/p{rng.randrange(3)}"
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = rng.choice([None, {}, {"Date": str(k), "Server": "x"}, {"date": str(k), "ETag": "e", "Content-Type": "t"}])
        rows.append((k, rng.choice([url] * 30 + [None]), rng.choice([rng.randrange(200)] * 30 + [None]), kind, 304 if kind == "revisit" else rng.choice([200, 200, 404]), rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "m1", "m2"]), headers, f"d{k}"))
    rows += [rows[3], rows[7]] if rows[3][3] == "revisit" else [r for r in rows if r[3] == "revisit"][:2]
    df = spark.createDataFrame(rows, CAPTURE).withColumns({"part": F.lit("mine"), "canonical": F.lit("mine")})
    for n in (1, 9):
        got = collected(revisits.resolve_revisits(df, n))
        assert collections.Counter((g["record_id"], g["canonical"], g["ts"], g["refers_to"], g["outcome"], tuple(sorted(g["headers"].items())) if g["headers"] is not None else None, g["digest"]) for g in got) == brute_revisits(rows)
    assert revisits.resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0
