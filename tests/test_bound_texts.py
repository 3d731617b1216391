"""What belongs to a whole document is computed once, not for each of its blocks."""

from regulith.catalog.texts import layout_docs
from regulith.plans import chunking


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_length_of_a_text_is_counted_once(spark, views):
    class V:
        def __call__(self, name):
            return views(name)

        dealt = __call__

    plan = _plan(chunking.with_paragraphs(layout_docs(V())).select("paragraphs"))
    assert plan.count("length(text") <= 1
