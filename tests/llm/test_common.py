import pyarrow as pa
from llm_data import docs

from evidrank.llm import common


def test_few_texts_are_python_objects_at_a_time(spark):
    """Rows keep their order and number, and no call of the work sees a whole Arrow batch."""
    made = [(k, f"t{k}" if k % 7 else None, "en", "a", 0) for k in range(3000)]
    rows = common.append(docs(spark, made).coalesce(1), lambda texts: [pa.array([len(texts)] * len(texts)), pa.array(texts)], {"n": "long", "copy": "string"})
    got = rows.collect()
    assert [(r.doc_id, r.copy) for r in got] == [(k, t or "") for k, t, *_ in made]
    assert max(r.n for r in got) <= 256
