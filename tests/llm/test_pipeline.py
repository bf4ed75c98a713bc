"""The pipeline on a small corpus: each stage takes out what it should and leaves the rest alone."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import test_llm_operators as ops
from auditlake.llm import quality, registry


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    bad = lambda n: " ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(n))
    docs = [(k, good(rng.randrange(60, 160))) for k in range(400)] + [(1000 + k, bad(100)) for k in range(200)]
    item = [good(30), good(25)]
    docs += [(2000, docs[3][1]), (2001, docs[3][1].upper().lower()), (2002, docs[5][1] + " tail"), (2003, f"{good(40)} {item[0]} {good(40)} {item[1]} {good(20)}"), (2004, f"{good(60)} {item[0]} {good(60)}"), (2005, None)]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in docs if i < 2000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, at, str(tmp_path))
        df.write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        left[name] = {r.doc_id: r for r in at.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any(1000 <= i < 2000 for i in left["quality"]) and sum(i < 1000 for i in left["quality"]) >= 396
    assert 2001 in left["exact_dedup"] and 3 not in left["exact_dedup"] and 2000 not in left["exact_dedup"]
    assert (5 in left["near_dedup"]) != (2002 in left["near_dedup"])
    kept = left["decontamination"]
    assert 2003 not in kept and item[0][:-1] not in kept[2004].text and kept[2004].n_chars == len(kept[2004].text)
    assert set(left["near_dedup"]) - set(kept) == {2003}
    assert set(left["mixing"]) <= set(kept)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_pipeline(rows, items, scores):
    """The five stages in plain Python: doc_id and text of every row of the mix."""
    rows = [r for r, score in zip(rows, scores, strict=True) if score >= 0.7]
    last = {}
    for r in sorted(rows, key=lambda r: r[0]):
        last[ops.lowered(r[1])] = r
    rows = sorted(last.values())
    classes = ops.brute_classes([{"text": r[1]} for r in rows])
    rows = [rows[min(c)] for c in classes]
    windows = [(i, set(ops.item_windows(t, 8)[1])) for i, t in items]
    clean = []
    for i, text, lang, source, n in rows:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ops.lowered(text))]
        w, hit, found = ops.item_windows(text, 8)[0], set(), set()
        for item, known in windows:
            for k in range(len(w)):
                for size in {len(x) for x in known}:
                    if tuple(w[k : k + size]) in known:
                        hit |= set(range(k, k + size))
                        found.add(item)
        if len(found) >= 2 or (hit and len(hit) == len(w)):
            continue
        if hit:
            kept, at = [], 0
            for k in range(len(w)):
                if k in hit and k - 1 not in hit:
                    kept.append(text[at : spans[k][0]])
                if k in hit:
                    at = spans[k][1]
            text = " ".join(x.strip() for x in [*kept, text[at:]]).strip()
            n = len(text)
        clean.append((i, text, lang, source, n))
    size = collections.Counter()
    for r in clean:
        size[r[3]] += len(r[1].split())
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(sorted(size))}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if level * weight[x] > 2 * size[x]}
        if not full:
            break
        for x in full:
            target[x] = 2.0 * size[x]
            left -= target[x]
        open_ -= full
    target |= {x: level * weight[x] for x in open_}
    out = collections.Counter()
    for r in clean:
        rate = target[r[3]] / size[r[3]]
        draw = int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        out[r] += int(rate) + (draw < rate - int(rate))
    return +out


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    bad = lambda n: " ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(n))
    docs = [(k, good(rng.randrange(30, 160))) for k in range(220)] + [(1000 + k, bad(80)) for k in range(110)]
    item = [good(30), good(12), "two words"]
    docs += [(2000 + k, docs[k][1].upper().lower() if k % 2 else docs[k][1]) for k in range(12)] + [(2100 + k, docs[20][1] + " tail" * (k % 3)) for k in range(9)] + [(2150, docs[30][1] + " end"), (2151, "start " + docs[30][1])]
    docs += [(2200 + k, f"{good(40)} {item[k % 2]} {good(30)}") for k in range(6)] + [(2300, f"{item[0]} {good(20)} {item[1]}"), (2301, item[0]), (2302, None), (2303, ""), (2304, good(3000))]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, DOCUMENTS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in docs if i < 2000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality.fit_on(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = brute_pipeline(rows, list(enumerate(item)), quality.score_texts(model, [(r[1] or "").encode() for r in rows]).tolist())
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and sum(got.values()) > len(got) > 200


def test_stages_on_empty_tables_and_repeated_rows(spark, tmp_path):
    empty, labels = spark.createDataFrame([], DOCUMENTS), "doc_id long, quality int, toxic int"
    rows = [(1, "one two three four five six", "en", None, 27)] * 3 + [(None, "seven eight nine", None, "a", 16), (2, None, "en", "a", None), (2, "", "en", "a", 0)]
    for name, df in (("empty", empty), ("repeats", spark.createDataFrame(rows, DOCUMENTS))):
        sf = f"{tmp_path}/{name}"
        df.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
            docs = spark.read.parquet(f"{sf}/{k}")
            assert docs.columns == df.columns
            if k == 3:
                left = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
                assert left == ([] if name == "empty" else [(1, rows[0][1]), (2, ""), (None, rows[3][1])])
        assert {(r.doc_id, r.text or "") for r in docs.collect()} <= set(left)


def test_registry_names_every_operator():
    names = set(registry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(registry.oracle_sql()) <= names
