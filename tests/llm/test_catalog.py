"""The subpackage's queries that have SQL, and all others, on the smallest tables."""

import pytest

from runloom.llm import catalog, mail, packing, pages
from tests import compare

pytestmark = pytest.mark.skipif(not compare.FOLDER.exists(), reason="no test tables")


def one(sql):
    return lambda con: con.execute(sql).fetchone()[0]


# what plain SQL can't say row by row: at least how many rows must come out, from another side
ROWS = {
    "p1_splits": one("SELECT (SELECT count(*) FROM folds) + (SELECT count(*) FROM e7_metrics)"),
    "p8_containers": lambda con: sum(max(1, -(-packing.count_tokens(t) // 2048)) for (t,) in con.execute("SELECT text FROM documents").fetchall()),
    "p9_found": lambda con: len(leaked(con)),
    "p9_passages": lambda con: sum(leaked(con).values()),
    "p9_clean": lambda con: sum(len(mail.readable_texts(t)) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if d not in dropped(con)),
    "p10_found": lambda con: sum(pages.features(t)[0] > 0.5 for (t,) in con.execute("SELECT text FROM documents").fetchall()),
}


def grams(con):
    out = {}
    for item, text in con.execute("SELECT item_id, text FROM eval_items").fetchall():
        w = mail.words(text or "")
        for i in range(len(w) - 11):
            out.setdefault(tuple(w[i : i + 12]), set()).add(item)
    return out


def marks(con):
    """(doc, item, part) -> places of words in twelve-word strings that the item holds too, by plain look-up."""
    of, out = grams(con), {}
    for doc, raw in con.execute("SELECT doc_id, text FROM documents").fetchall():
        for part, text in enumerate(mail.readable_texts(raw)):
            w = mail.words(text)
            for i in range(len(w) - 11):
                for item in of.get(tuple(w[i : i + 12]), ()):
                    out.setdefault((doc, item, part, len(w)), set()).add(i)
    return out


def leaked(con):
    """(doc, item) -> number of stretches."""
    out = {}
    for (doc, item, _, _), at in marks(con).items():
        out[doc, item] = out.get((doc, item), 0) + sum(not any(j in at for j in range(i - 12, i)) for i in at)
    return out


def dropped(con):
    covered = {}
    for (doc, _, part, n), at in marks(con).items():
        covered.setdefault((doc, part, n), set()).update(j for i in at for j in range(i, i + 12))
    return {doc for (doc, _, n), at in covered.items() if len(at) > 0.5 * n}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, str(compare.FOLDER))
    if sql := catalog.oracle_sql().get(name):
        compare.same(df, compare.connection(), sql)
    else:
        assert df.count() == ROWS[name](compare.connection())


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "runloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "runloom.llm" in p.read_text()]
