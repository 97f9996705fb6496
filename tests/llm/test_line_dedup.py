from cuewright.llm import line_dedup as L


def test_first_occurrence_stays(spark):
    line, rare = "share this page with all friends", "a line of only three sites"
    rows = [(i, f"own text of number {i} here\n  {line} \nend", f"s{i % 6}") for i in range(12)]
    rows += [(100 + i, f"{rare}\nshort", f"s{i}") for i in range(3)]
    rows += [(200, None, "s1"), (201, "", None), (202, f"{line}\n{line}", None), (None, line, "s9"), (203, "tiny line", "s1"), (3, "own text of number 3 here", "s0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_removed"]) for r in L.dedup_lines(df).collect()}
    assert len(got) == len(rows)
    # the smallest id is the null one: it keeps the line
    assert got[(None, line)] == (1, 0)
    assert got[(0, "own text of number 0 here\nend")] == (3, 1)
    assert got[(202, "")] == (2, 2) and got[(200, None)] == (0, 0) and got[(201, "")] == (1, 0)
    assert got[(100, f"{rare}\nshort")] == (2, 0)


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(s * 10 + c, f"line number {c} of the test", f"site{s}") for c in range(2, 9) for s in range(c)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = L.boilerplate(L.counted_lines(df, "doc_id", "text", "source", L.MIN_WORDS), 5)
    assert found.count() == 4  # those of five, six, seven and eight sites


def test_any_blanks_at_the_ends_are_no_part_of_a_line(spark):
    line = "share this page with all friends"
    forms = [f"\t{line}", f"{line}\r", f" \t{line} \x0b", f"\x0c{line}", line]
    rows = [(i, f"own text of number {i} here\r\n{form}\n\u00a0end", f"s{i}") for i, form in enumerate(forms)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(df).collect()}
    # the first occurrence stays as it is written
    assert got[0] == (rows[0][1], 3, 0)
    assert all(got[i] == (f"own text of number {i} here\r\n\u00a0end", 3, 1) for i in range(1, 5))
    # three words are too few, whatever blanks stand around them
    short = spark.createDataFrame([(i, "\tonly three words\r", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    assert L.removed_lines(short).count() == 0


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    line = "share this page with all friends"
    rows = [(i, f"text number {i}\n{line}", f"s{i}") for i in range(6)]
    one, two = f"own words here\n{line}\nend", "another first line\nkeep this line of mine please\nlast"
    rows += [(3, one, "s3"), (3, two, "s3"), (3, one, "s3"), (None, one, "s1"), (None, two, "s1")]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    found = sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] == 3)
    assert found == [(3, "another first line\nkeep this line of mine please\nlast"), (3, "own words here\nend"), (3, "own words here\nend"), (3, "text number 3")]
    # the row without an id is the first: it keeps the line, all others lose it
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == [two, one]
    assert sum(line in r["text"] for r in got) == 1


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
