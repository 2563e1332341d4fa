import corpus_pipeline
from fixtures_llm import rows
from test_decontamination import expected as leaks
from test_fertility import BANDS, base, verdict
from test_lattice import MODEL
from test_line_dedup import expected as repeated
from test_simhash import classes, fingerprint

from revisit.llm.queries import LLM_QUERIES
from revisit.llm.simhash import representatives


def cut(pairs):
    gone = repeated(pairs, 5)
    return [
        (k, "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in pairs
    ]


def brute_force(documents, items):
    """Keys and texts after all filters, by the tests' plain versions of the operators."""
    good = [
        (d["doc_id"], d["text"]) for d in documents
        if not base(d["text"])[-1] and verdict(d["text"], BANDS[d["lang"]])[1]
    ]
    rest = cut(good)
    component = classes([(k, fingerprint(t)) for k, t in rest])
    single = [(k, t) for k, t in rest if component[k] == k]
    leaking = {d for d, *_ in leaks(single, items)}
    return {k: t for k, t in single if k not in leaking}


def test_rows_equal_brute_force(spark, tiny, documents):
    made = {r.doc_id: r for r in LLM_QUERIES["pipeline"](spark, tiny).collect()}
    wanted = brute_force(documents, [(i["item_id"], i["text"]) for i in rows(tiny, "benchmark")])
    assert set(made) == set(wanted) and 0 < len(wanted) < len(documents)
    for k, text in wanted.items():
        assert MODEL.decode(made[k].ids) == text and made[k].n_tokens == len(made[k].ids)


def test_stages_keep_the_columns(spark, docs_of, tiny):
    docs = docs_of(["a b c", None, ""])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tiny).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), tiny).count() == 0


def test_one_document_of_each_group_stays(docs_of):
    docs = docs_of([(3, "q w e r"), (2, "q w e r"), (2, "q w e r"), (None, "q w e r"), (5, "z x c v"), (6, "z x c v")])
    assert sorted((r.doc_id or 0) for r in representatives(docs).collect()) == [0, 2, 5]
