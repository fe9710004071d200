import cases
import corpus_pipeline
import duckdb
import oracle
import pytest

from leakscope.llm import line_dedup
from leakscope.llm.oracles import ORACLES
from leakscope.llm.queries import op7_line_dedup


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def brute(rows, least):
    lines = [((d, p), x) for d, t in rows if d is not None for p, x in enumerate((t or "").split("\n")) if len(x) >= least]
    out = {}
    for place, line in lines:
        near = [(p, x) for p, x in lines if p < place and within_one_edit(line, x)]
        if near:
            out[place] = ("exact" if any(x == line for _, x in near) else "near", min(near)[0])
    return out


ROWS = [
    (1, "hello world\nshort\nabcdé😀fghij"),
    (2, "hello worl\nabcdé😀fghi\nxello world"),
    (3, "hello world\nhello world\n\n"),
    (None, "hello world"),
    (4, None),
    (5, ""),
    (6, "abcdé😀fghix\nhello wrld\nhelo worl"),
    (7, "hello world"),
    (7, "hello world"),
    (8, "helloo world\nhellooo world"),
    (-9, "aaaaaaaa\naaaaaaaaa\naaaaaaaab"),
]


def test_copies_match_brute_force(spark):
    found = line_dedup.line_copies(cases.documents(spark, ROWS), min_chars=8)
    got = {(r.doc, r.position): (r.kind, (r.first_doc, r.first_position)) for r in found.collect()}
    assert got == brute(ROWS, 8)


def test_hot_template_lines(spark):
    rows = [(i, f"the same long line of page {chr(0x4E00 + i)} again\nthe same header for every page of all") for i in range(300)]
    found = line_dedup.line_copies(cases.documents(spark, rows)).collect()
    assert len(found) == 598 and {r.first_doc for r in found} == {0}


def test_text_is_rebuilt(spark):
    docs = cases.documents(spark, ROWS)
    got = {r["row"]["doc_id"]: r.kept_text for r in line_dedup.deduplicate(docs, min_chars=8).collect()}
    assert got[1] == ROWS[0][1] and got[2] == "" and got[3] == "\n" and got[None] == "hello world" and got[7] == "hello world"


def test_mostly_copied_text_stays_whole(spark):
    shared, own = "a line that both of the documents have", "a much longer line that only the second document has got"
    rows = [(1, shared), (2, f"{shared}\n{own}"), (3, shared), (4, f"{own[:35]}x\n{own[:35]}x")]
    got = {r["row"]["doc_id"]: r.kept_text for r in line_dedup.deduplicate(cases.documents(spark, rows), most_copied=0.5).collect()}
    assert got == {1: shared, 2: own, 3: shared, 4: own[:35] + "x"}


def test_awkward_rows(spark):
    docs = cases.documents(spark, cases.awkward())
    assert line_dedup.deduplicate(docs).count() == len(cases.awkward())
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.line_copies(docs, max_edits=2)


def test_pipeline_stage_cuts_copies_from_every_text(spark):
    shared = [f"shared passage number {i} that several of the documents hold" for i in "abcdefg"]
    own = [f"{w} is all that this document has of its own, and it stays" for w in ("one", "two and more", "three, later")]
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared[:5], own[0]])), (3, "\n".join([own[1], *shared])), (4, "\n".join(shared[2:])), (5, own[2]), (6, "")]
    docs = cases.documents(spark, rows)
    copied = brute(rows, 30)
    left = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in copied) for d, t in rows}
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_copied_lines(spark, docs, "").collect()}
    assert got == {d: left[d] for d, t in rows if left[d] or not t} and set(got) == {1, 2, 3, 5, 6}


def test_short_lines_are_exact_copies_only(spark):
    licence, short = "Licensed under CC BY-NC 4.0.", "Of."
    rows = [(1, f"{licence}\n{short}\n\n \t"), (2, f"{licence}\n{short}\nOn.\n\n \t"), (3, f"{licence[:-1]}\nOn.\n12345678"), (4, "1234567\n12345679")]
    found = line_dedup.line_copies(cases.documents(spark, rows)).collect()
    got = {(r.doc, r.position): (r.kind, r.first_doc, r.first_position) for r in found}
    assert got == {
        (2, 0): ("exact", 1, 0), (2, 1): ("exact", 1, 1), (3, 0): ("near", 1, 0), (3, 1): ("exact", 2, 2), (4, 1): ("near", 3, 2)
    }


def test_near_copies_of_any_length_by_parameter(spark):
    rows = [*ROWS, (20, "a\nb\nab\n \n" + "y" * 3000), (21, "y" * 1500 + "z" + "y" * 1500)]
    found = line_dedup.line_copies(cases.documents(spark, rows), near_chars=1)
    got = {(r.doc, r.position): (r.kind, (r.first_doc, r.first_position)) for r in found.collect()}
    kept = [(d, t.replace("\n \n", "\n\n") if t else t) for d, t in rows]  # blank lines are no copies
    assert got == brute(kept, 1)


def test_query_and_sql_take_near_copies_of_short_lines(spark, tmp_path):
    rows = [(1, "abcdef\nOf.\nx"), (2, "abcdeg\nOn.\n\n \t"), (3, "abcde\nabcdef\nlonger than eight"), (4, "longer than eigh\n7777777"), (5, "y\n777777"), (6, None)]
    cases.documents(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = op7_line_dedup(spark, str(tmp_path))
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in found.collect()}
    assert got == {1: (3, 0, 0), 2: (4, 0, 2), 3: (3, 1, 1), 4: (2, 0, 1), 5: (2, 0, 2), 6: (1, 0, 0)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.difference(found, con, ORACLES["op7_line_dedup"]) is None


def test_characters_stay_with_their_line(spark, monkeypatch):
    plans, kept = {}, line_dedup.once

    def once(table, name):
        plans[name] = table._jdf.queryExecution().executedPlan().toString().splitlines()
        return kept(table, name)

    monkeypatch.setattr(line_dedup, "once", once)
    line_dedup.line_copies(cases.documents(spark, ROWS))
    # Below the sums over a line's characters, no exchange before the lines are cut into them.
    plan = plans["known-lines"]
    generate = next(i for i, x in enumerate(plan) if "Generate posexplode" in x)
    window = max(i for i, x in enumerate(plan[:generate]) if "Window [" in x)
    assert not [x for x in plan[window:generate] if "Exchange" in x]
