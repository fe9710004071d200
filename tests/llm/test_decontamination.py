import cases
import regex

from leakscope.llm import decontamination as d

ITEM = "A train leaves the old station with 120 tons of coal and meets Anna after 45 minutes near the bridge in Lyon where Anna buys 3 kg of flour"
RENAMED = "A train leaves the old station with 75 tons of coal and meets Peter after 20 minutes near the bridge in Porto where Peter buys 9 kg of flour"
MIXED = "A train leaves the old station with 75 tons of coal and meets Peter after 20 minutes near the bridge in Porto where Maria buys 9 kg of flour"
SHORT = "What is the capital city of Peru today"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def leaks(spark, texts, benchmark):
    found = d.leaks(cases.documents(spark, texts), items(spark, benchmark))
    return {(r.doc_id, r.item_id): r.changed for r in found.collect()}


def test_copies_and_new_parameters_are_found(spark):
    noise = "some words before the passage begin here. "
    texts = [(1, noise + ITEM + ". And more."), (2, noise + RENAMED), (3, noise * 5), (4, MIXED), (None, ITEM), (5, None), (6, "")]
    found = {(1, 10): False, (2, 10): True, (4, 10): True, (None, 10): False}
    assert leaks(spark, texts, [(10, ITEM), (10, ITEM), (11, None)]) == found


def test_short_items_must_occur_whole(spark):
    texts = [(1, f"Well. {SHORT}?"), (2, "What is the capital city of"), (3, "What is the capital city of Chad today")]
    assert leaks(spark, texts, [(1, SHORT), (2, "of Peru")]) == {(1, 1): False, (1, 2): False, (3, 1): True}


def test_templates_of_slots_only_match_nothing(spark):
    assert leaks(spark, [(1, "we had 1 2 3 4 5 6 7 8 9 10 11 12 13 14")], [(1, "we had 7 8 9 10 11 12 13 14 15 16 17 18 19 20")]) == {}


def test_a_value_that_fits_nowhere_costs_only_its_windows(spark):
    last = ITEM.replace("where Anna", "where Maria")
    equal = ITEM.replace("120", "60").replace("45", "60")
    merged = "Once Anna met Bruno near the old bridge of the town at night"
    texts = [(1, last), (2, equal), (3, merged.replace("Anna", "Eva").replace("Bruno", "Eva")), (4, merged.replace("Bruno", "Eva"))]
    assert leaks(spark, texts, [(10, ITEM), (11, merged)]) == {(1, 10): True, (2, 10): True, (4, 11): True}


def test_word_for_word_copies_are_found_whatever_they_are_made_of(spark):
    numbers = "1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    texts = [(1, f"we had {numbers} and so on"), (2, "he asked: Who wrote Faust then"), (3, "who wrote Hamlet")]
    assert leaks(spark, texts, [(1, numbers), (2, "Who wrote Faust")]) == {(1, 1): False, (2, 2): False}


def test_a_first_name_counts_after_a_colon(spark):
    texts = [(1, "Question: Peter buys seven apples and two pears at the market"), (2, "Peter buys seven apples and two pears at the market")]
    item = "Anna buys seven apples and two pears at the market"
    assert leaks(spark, texts, [(1, item)]) == {(1, 1): True, (2, 1): True}


def _template(text):
    """(word, type or None, opens a sentence) of each token."""
    found, opens, marks = [], True, regex.findall(d._TOKEN, text or "")
    for mark in marks:
        if mark in ".!?\n":
            opens = True
            continue
        found.append([mark.lower(), "number" if mark[0].isnumeric() else None, opens and mark[0].isupper() and mark[1:].islower()])
        if found[-1][1] is None and not opens and mark[0].isupper() and mark[1:].islower() and mark.lower() not in d.UNITS:
            found[-1][1] = "name"
        found[-1][2] = found[-1][2] and mark.lower() not in d.UNITS
        opens = False
    numbers = [t[1] == "number" for t in found]
    for i, token in enumerate(found):
        beside = numbers[max(i - 1, 0) : i] + numbers[i + 1 : i + 2]
        if token[0] in d.UNITS and any(beside):
            token[1] = "unit"
    return found


def _forms(window):
    """Every reading of a window as (template, values); a first capital may be a name."""
    yield tuple(w for w, _, _ in window), ()
    if len(window) < 5:
        return
    readings = [[(w, kind) for w, kind, _ in window]]
    if window[0][2]:
        readings.append([(window[0][0], "name"), *readings[0][1:]])
    for reading in readings:
        values = tuple((kind, w) for w, kind in reading if kind)
        if values and len(window) - len(values) >= 0.6 * len(window):
            yield tuple(("slot", kind) if kind else w for w, kind in reading), values


def _brute(docs, benchmark):
    held, whole = {}, {}
    for item, text in benchmark:
        tokens = _template(text)
        size = min(len(tokens), 13)
        for at in range(len(tokens) - size + 1 if size else 0):
            for form, values in _forms(tokens[at : at + size]):
                whole.setdefault(form, set()).add((item, at, values))
    sizes = {len(form) for form in whole}
    for doc, text in docs:
        tokens = _template(text)
        for size in sizes:
            for at in range(len(tokens) - size + 1):
                for form, values in _forms(tokens[at : at + size]):
                    for item, item_at, item_values in whole.get(form, ()):
                        pairs = set(zip(item_values, values))
                        names = {p for p in pairs if p[0][0] == "name"}
                        if len({a for a, _ in pairs}) == len(pairs) and len({b for _, b in names}) == len(names):
                            held.setdefault((doc, item, at - item_at), []).append((at, values != item_values))
    found = {}
    for (doc, item, _), windows in held.items():
        n, changed = found.get((doc, item), (0, True))
        found[doc, item] = n + len({at for at, _ in windows}), changed and any(c for _, c in windows)
    return found


def test_given_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    made = [(-1, ITEM), (-2, RENAMED), (-3, MIXED), (-4, "Well: Peter buys 4 apples for 3 euros"), (-5, "1 2 3"), (-6, "in 3 days. 4")]
    extra = [(-1, ITEM), (-4, "Anna buys 9 apples for 2 euros"), (-5, "1 2 3"), (-6, "in 3 days")]
    found = d.leaks(docs.union(spark.createDataFrame(made, docs.schema)), benchmark.union(spark.createDataFrame(extra, benchmark.schema)))
    rows = {(r.doc_id, r.item_id): (r.n_windows, r.changed) for r in found.collect()}
    brute = _brute([*made, *map(tuple, docs.collect())], [*extra, *map(tuple, benchmark.collect())])
    assert len(rows) > 5 and rows == brute


def test_clean_keeps_columns_and_rows_without_leaks(spark):
    docs = cases.documents(spark, [*cases.awkward(), (20, ITEM), (20, "another text"), (None, ITEM)])
    kept = d.clean(docs, items(spark, [(1, ITEM)]))
    assert kept.columns == docs.columns and kept.count() == len(cases.awkward()) + 1
    assert d.clean(docs.limit(0), items(spark, [(1, ITEM)])).count() == 0
    assert d.clean(docs, items(spark, [])).count() == docs.count()
