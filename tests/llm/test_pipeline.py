"""The pipeline against a plain version of its stages, and its frame."""

import os
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from mergrove.llm import common, quality
from tests.llm.test_linededup import brute as plain_lines
from tests.llm.test_similar import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, in turn."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = common.scratch(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/test-{os.getpid()}-{i}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(stages) == 5 and all(s.columns == columns for s in stages[:-1])


def test_quality_stage(spark, stages):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    good = {r["doc_id"] for r in rows(docs) if model.score([quality.statistics(r["text"])])[0] >= 0.3}
    assert {r["doc_id"] for r in rows(stages[0])} == good
    marks = {r.doc_id: r.quality for r in labels.collect()}
    clean = [d for d, q in marks.items() if q == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)
    bad = [d for d, q in marks.items() if q == 0]
    assert sum(d in good for d in bad) <= 0.15 * len(bad)


def test_line_stage(stages):
    before = rows(stages[0])
    want = plain_lines([(r["source"], r["text"]) for r in before], 0.1)
    assert Counter((r["doc_id"], r["text"]) for r in rows(stages[1])) == Counter((r["doc_id"], t) for r, t in zip(before, want))


def test_near_stage(stages):
    before = rows(stages[1])
    assert {r["doc_id"] for r in rows(stages[2])} == brute_kept([(r["doc_id"], r["text"]) for r in before])
    text = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == text[r["doc_id"]] for r in rows(stages[2]))


def test_mixing_stage(stages):
    assert Counter(map(str, rows(stages[3]))) == Counter(map(str, rows(stages[2])))
    order = [r.source for r in stages[3].selectExpr("*", "_metadata.file_path f", "_metadata.row_index i").orderBy("f", "i").collect()]
    total = Counter(order)
    weight = {s: n**0.5 / sum(m**0.5 for m in total.values()) for s, n in total.items()}
    first = order[: len(order) // 3]
    # blocks of 16 rows, less than one of them off, while all sources last
    lasting = min(n / weight[s] for s, n in total.items())
    if lasting >= len(first):
        assert all(abs(Counter(first)[s] - w * len(first)) <= 33 for s, w in weight.items())


def test_encoding_stage(stages):
    own = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    text = {r["doc_id"]: r["text"] for r in rows(stages[3])}
    got = rows(stages[4])
    assert {r["doc_id"] for r in got} == set(text)
    for r in got:
        assert list(r["ids"]) == own.encode(text[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) and r["round_trip"] and r["parity"]


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r["doc_id"], r["ids_sha256"], r["n_tokens"])
    assert Counter(map(key, rows(corpus_pipeline.run(spark, SF)))) == Counter(map(key, rows(stages[4])))


def test_stages_on_odd_input(spark):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, and columns that clash with a stage's own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, Text int, DOC_ID int, file int, position int, fp int, node int, c1 int, slot int"
    long = "word the of and. " * 9000
    body = [(None, "a b", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (4, long, None, "t", None), (None, None, None, None, None)]
    odd = spark.createDataFrame([(*r, *range(8)) for r in body], schema)
    good = {"quality classifier": None, "line dedup": 7, "simhash near-dedup": 4, "mixing": 7, "sentencepiece": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        found = [tuple(r) for r in out.collect()]
        if name == "sentencepiece":
            texts = dict(zip([str(r[0]) for r in body], [r[1] for r in body]))
            assert all((r[3] > 0) == bool(texts[str(r[0])]) for r in found if r[0] is not None) and all(r[6] and r[7] for r in found)
        else:
            assert out.columns == odd.columns and all(r[5:] == tuple(range(8)) for r in found)
            assert not {r[:2] for r in found} - {r[:2] for r in body} or name == "line dedup"
        assert good[name] is None or len(found) == good[name], name
        if name == "simhash near-dedup":  # null and empty are one group, the two long texts another; null ids stay
            assert Counter(str(r[0]) for r in found) == {"None": 2, "1": 1, "3": 1}
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_import_guard_stands_alone():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    entry = open(os.path.join(root, "__spark_entry__.py")).read()
    assert entry.count("except ImportError") == 2
    for folder, _, files in os.walk(os.path.join(root, "mergrove")):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                if not folder.endswith("llm"):
                    assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", text), f
                else:
                    assert "except ImportError" not in text


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n for n in names if re.match(r"op\d+_", n)} and {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
    by = defaultdict(list)
    for n in names:
        by[n.split("_")[0]].append(n)
    assert all(len(v) == 1 for k, v in by.items() if re.fullmatch(r"op\d+", k))
