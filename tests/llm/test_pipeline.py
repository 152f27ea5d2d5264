"""The pipeline's stages against brute force, on documents with every odd case."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import quality, rules
from tests.llm.test_corpus_operators import WORD, brute_components, junk, ordered, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    draw = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "the of river stone old bridge water slow".split() for b in ("", "s", "en", "ing", "ly")]
    rows = []
    for g in range(40):
        text = [w for line in range(4) for w in prose(draw, words, 40).split()]
        rows.append((10 * g, " ".join(text)))
        for c, changed in enumerate((0, 1, 4, 12)[: g % 5], 1):  # exact and near copies, and some that are too far
            some = list(text)
            for at in draw.choice(len(some), size=changed, replace=False):
                some[at] = f"new{at}"
            rows.append((10 * g + c, " ".join(some)))
    rows += [(5000 + i, junk(draw, words, k)) for i, k in enumerate(["symbols", "shouting", "bars", "stutter"] * 6)]
    rows += [(6000, None), (6001, ""), (None, rows[0][1]), (None, None), (0, rows[0][1]), (0, rows[0][1]), (6002, "Two words."), (6003, rows[5][1] + "\nHOME | NEWS | SPORT | MORE")]
    rows += [(7000, " ".join(prose(draw, words, 4000) for _ in range(5)))]
    where = tmp_path_factory.mktemp("sf")
    table = [(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(table, COLUMNS).write.parquet(f"{where}/documents.parquet")
    return str(where)


def jaccard_copies(rows):
    """The smallest id of each row's group, by the similarity of all pairs' five-word shingles."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").lower())
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)})
    place = {id(r): s for r, s in zip(rows, sets)}
    return brute_components(rows, lambda a, b: len(place[id(a)] & place[id(b)]) >= 0.8 * len(place[id(a)] | place[id(b)]))


def test_every_stage_equals_brute_force_and_run_is_all_of_them(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "best_fit_packing"]
    (_, classify), (_, clean), (_, dedup), (_, pack) = corpus_pipeline.STAGES

    first = classify(spark, docs, documents)
    assert first.schema == docs.schema
    kept = [tuple(r) for r in first.collect()]
    model = quality.fit(docs)
    _, scores = quality.scorer(model)
    assert ordered(kept) == ordered(r for r in given if scores(quality.Features(), [r[1]])[0] >= 0.5)
    assert not [r for r in kept if (r[0] or 0) in range(5000, 6000)] and sum((r[0] or 0) < 5000 for r in kept) == sum((r[0] or 0) < 5000 and r[1] is not None for r in given)

    second = clean(spark, first, documents)
    assert second.columns == docs.columns
    judged = [(r, rules.judge(r[1])) for r in kept]
    want = [(r[0], v.cleaned, r[2], r[3], len(v.cleaned)) for r, v in judged if v.kept]
    assert ordered(map(tuple, second.collect())) == ordered(want) and not any("NEWS" in r[1] for r in want)

    third = dedup(spark, second, documents)
    groups = {}
    for row, component in zip(want, jaccard_copies([r[:2] for r in want])):
        groups.setdefault(component, []).append(row)
    stay = [min((r for r in rows if r[0] == component), key=repr) for component, rows in groups.items()]
    found = [tuple(r) for r in third.collect()]
    assert third.columns == docs.columns and ordered(r[:2] for r in found) == ordered(r[:2] for r in stay)
    assert len(found) < len(want)

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    lengths = {r[0]: len(encode(r[1], add_special_tokens=False).ids) + 1 for r in found}
    last = pack(spark, third, documents).collect()
    held = {}
    for r in last:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == lengths and len({r.sequence_id for r in last}) == -(-sum(lengths.values()) // 4096)

    rows = lambda some: ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in some)
    assert rows(corpus_pipeline.run(spark, documents).collect()) == rows(last)


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
