"""COBOL sources: programs, copybooks, spans, data descriptions, and their projection to the knowledge graph.

Sources are (path, text). Lines keep the numbers they have in the expanded text: comment lines are emptied, not
taken out. Sections and paragraphs start at their headers and end before the next header of either kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.tables import cut
from lodestrata.functions.text import any_case, file_name, group, lines, located, parent, stem, suffix
from lodestrata.operators.fixed import (
    BOOK_FOLDERS, BOOK_HEADERS, BOOK_SUFFIXES, CALL_LITERAL, COPY_IMPORT, COPY_LINE, EXEC_CICS, EXEC_SQL, FILE_ACCESS, OCCURS,
    PARAGRAPH_HEADER, PERFORM, PROCEDURE_DIVISION, PROCEDURE_USING, PROGRAM_ID, READING_VERBS, REDEFINES, SECTION_HEADER,
    SELECT_ASSIGN, TERMINATORS,
)
from lodestrata.operators.graph import edge_rows, node_rows, union_all

_UP_TO = Window.unboundedPreceding
_ENTRY = r"^\s*(\d{1,2})\s+([A-Za-z][\w-]*)"
_PICTURE = any_case(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+?)\.?(?:\s|$)")
_VALUE = any_case(r"\bVALUES?(?:\s+IS)?\s+(\S+(?:\s+THR(?:U|OUGH)\s+\S+)?)")


def strip_comments(source: DataFrame) -> DataFrame:
    """Lines (path, line_no, line) whose seventh character isn't * or /; numbers stay."""
    return source.where(~F.substring("line", 7, 1).isin("*", "/"))


def without_comments(text: Column) -> Column:
    """The text with comment lines emptied."""
    return F.regexp_replace(text, r"(?m)^.{6}[*/].*$", "")


def program_name(path: Column, text: Column) -> Column:
    """The PROGRAM-ID, or the file's stem in upper case."""
    return F.upper(F.coalesce(group(without_comments(text), "(?im)" + PROGRAM_ID), stem(path)))


def copybooks(files: DataFrame, folders: tuple[str, ...] = BOOK_FOLDERS) -> DataFrame:
    """(name, priority, text, file) of the books among files (path, text): by folder in this order, then by suffix."""
    place = F.coalesce(*(F.when(parent(F.col("path")) == f, i) for i, f in enumerate(folders)))
    kind = F.coalesce(*(F.when(suffix(F.col("path")) == s, i) for i, s in enumerate(BOOK_SUFFIXES)))
    found = files.select(F.upper(stem(F.col("path"))).alias("name"), (place * len(BOOK_SUFFIXES) + kind).alias("priority"), "text", file_name(F.col("path")).alias("file"))
    return found.where("priority is not null")


def expand_copybooks(source: DataFrame, books: DataFrame) -> DataFrame:
    """Lines with COPY directives replaced by the book (name, priority, text) of least priority; unresolved ones stay.

    ``sub`` orders inserted lines. Headers of a whole program in a book are left out. COPY REPLACING stays as it is.
    """
    name = F.upper(group(F.col("line"), any_case(COPY_LINE)))
    best = books.groupBy(F.upper("name").alias("book")).agg(F.min_by("text", "priority").alias("book_text"))
    joined = source.withColumn("book", name).join(best, "book", "left")
    header = lambda x: F.lower(F.trim(x)).rlike("^(?:" + "|".join(BOOK_HEADERS) + ")")
    body = F.filter(F.split(F.rtrim("book_text"), "\n", -1), lambda x: ~header(x))
    each = F.posexplode(F.when(F.col("book_text").isNull(), F.array("line")).otherwise(body)).alias("sub", "line")
    return joined.select("path", "line_no", each)


def expanded(files: DataFrame, books: DataFrame | None) -> DataFrame:
    """(path, text) with books inlined; lines are numbered anew by what follows."""
    if books is None:
        return files.select("path", "text")
    own = expand_copybooks(lines(files), books)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "sub", "line")))
    return own.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def copy_imports(files: DataFrame) -> DataFrame:
    """(path, line_no, module): books named by COPY, before expansion."""
    own = strip_comments(lines(files)).select("path", "line_no", F.upper(group(F.col("line"), any_case(COPY_IMPORT))).alias("module"))
    return own.where("module is not null")


def cobol_spans(source: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line, section) of sections and paragraphs after PROCEDURE DIVISION."""
    by_file = Window.partitionBy("path")
    w = by_file.orderBy("line_no")
    section, para = group(F.col("line"), any_case(SECTION_HEADER)), group(F.col("line"), PARAGRAPH_HEADER)
    begun = F.min(F.when(F.col("line").rlike(any_case(PROCEDURE_DIVISION)), F.col("line_no"))).over(by_file)
    told = source.withColumns({"begun": begun, "last": F.max("line_no").over(by_file), "s": section, "p": para})
    named = F.col("s").isNotNull() | (F.col("p").isNotNull() & ~F.upper("p").isin(*TERMINATORS))
    heads = told.where((F.col("line_no") > F.col("begun")) & named)
    heads = heads.withColumns({"section": F.last("s", True).over(w.rowsBetween(_UP_TO, 0)), "next": F.lead("line_no").over(w)})
    return heads.select(
        "path", F.when(F.col("s").isNotNull(), "section").otherwise("paragraph").alias("kind"), F.upper(F.coalesce("s", "p")).alias("name"),
        F.col("line_no").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("last")).alias("end_line"), F.upper("section").alias("section"),
    )


def in_paragraph(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (path, line_no, ...) with the paragraph whose span holds them: an as-of join by a window, without a range join."""
    own = [c for c in points.columns if c not in ("path", "line_no")]
    marks = spans.where("kind = 'paragraph'").select("path", F.col("start_line").alias("line_no"), F.struct("name", "end_line").alias("_span"), F.lit(0).alias("_o"))
    both = points.withColumn("_o", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("line_no", "_o").rowsBetween(_UP_TO, 0)
    got = both.withColumn("_span", F.last("_span", True).over(w)).where("_o = 1")
    inside = F.when(F.col("line_no") <= F.col("_span.end_line"), F.col("_span.name"))
    return got.select("path", "line_no", *own, inside.alias("paragraph"))


def statements(files: DataFrame) -> DataFrame:
    """(path, line_no, end_line, op, target, body): calls, SQL and CICS blocks, performs and file verbs, once a line and op.

    ``op`` is call, sql, cics, perform or a file verb; a block's target is its first word. Verbs of comments aren't taken.
    """
    plain = files.select("path", without_comments(F.col("text")).alias("text"))

    def found(op: Column, pattern: str, target: Column, body: Column | None = None, names: dict[str, int] | None = None) -> DataFrame:
        at = located(plain, pattern, names or {"a": 1})
        none = F.lit(None).cast("string")
        return at.select("path", "number", "line_no", "end_line", op.alias("op"), F.upper(target).alias("target"), (none if body is None else body).alias("body"))

    word = F.coalesce(group(F.col("a"), r"^\s*([A-Za-z][\w-]*)"), F.lit("?"))
    blocks = [found(F.lit(op), "(?is)" + p, word, F.trim("a")) for op, p in (("sql", EXEC_SQL), ("cics", EXEC_CICS))]
    every = [found(F.lit("call"), any_case(CALL_LITERAL), F.col("a")), found(F.lit("perform"), any_case(PERFORM), F.col("a")), *blocks]
    # a hyphen before a verb makes it another word, as in END-READ
    every.append(found(F.lower("v"), any_case(r"(?<!-)" + FILE_ACCESS), F.col("a"), names={"v": 1, "a": 2}))
    return union_all(every).withColumn("at", F.row_number().over(Window.partitionBy("path", "line_no", "op").orderBy("number"))).where("at = 1").drop("at", "number")


def service_calls(files: DataFrame) -> DataFrame:
    """(path, line_no, service, operation) of calls, blocks and file verbs."""
    s = statements(files).where("op <> 'perform'")
    service = F.when(F.col("op") == "call", "cobol-call").when(F.col("op") == "sql", "db2-exec-sql").when(F.col("op") == "cics", "cics").otherwise("vsam")
    operation = F.when(service == "vsam", F.concat_ws(":", "op", "target")).otherwise(F.col("target"))
    return s.select("path", "line_no", service.alias("service"), operation.alias("operation"))


def data_items(files: DataFrame) -> DataFrame:
    """(path, line_no, end_line, holder, record, level, name, pic, redefines, occurs, occurs_min, occurs_max, depending_on, group_name, conditions).

    Entries of FILE and WORKING-STORAGE sections, from their first line to the one with the full stop. ``holder`` is
    the file description above the record, null in working storage; ``group_name`` the nearest entry before of a
    lower level; 88 levels fold into the entry before them as NAME=VALUE, joined by ``|``.
    """
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(_UP_TO, 0)
    own = strip_comments(lines(files))
    section = F.upper(group(F.col("line"), any_case(r"^\s*(FILE|WORKING-STORAGE|LINKAGE|LOCAL-STORAGE)\s+SECTION\s*\.")))
    mark = F.when(section.isNotNull(), section).when(F.col("line").rlike(any_case(PROCEDURE_DIVISION)), "PROCEDURE")
    own = own.withColumn("mark", mark).withColumn("section", F.last("mark", True).over(w))
    own = own.where("mark is null and section in ('FILE', 'WORKING-STORAGE') and trim(line) <> ''")
    # an entry goes on until a line that ends with a full stop
    before = Window.partitionBy("path").orderBy("line_no")
    starts = F.coalesce(F.lag(F.rtrim("line").endswith(".")).over(before), F.lit(True))
    own = own.withColumn("starts", starts).withColumn("entry", F.sum(F.col("starts").cast("int")).over(w))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"]))
    e = own.groupBy("path", "entry").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("end_line"), F.first("section").alias("section"), F.array_join(pieces, " ").alias("t"))
    t = F.col("t")
    e = e.withColumns({
        "fd": F.upper(group(t, any_case(r"^FD\s+([A-Za-z][\w-]*)"))), "level": group(t, _ENTRY).cast("int"), "name": F.upper(group(t, _ENTRY, 2)),
        "file": F.when(F.col("section") == "FILE", F.lit(1)),
    })
    e = e.where("fd is not null or level is not null")
    e = e.withColumn("holder", F.when(F.col("file") == 1, F.last("fd", True).over(w))).where("level is not null")
    e = e.withColumn("record_line", F.last(F.when(F.col("level") == 1, F.col("line_no")), True).over(w)).where("record_line is not null")
    in_record = Window.partitionBy("path", "record_line").orderBy("line_no").rowsBetween(_UP_TO, 0)
    e = e.withColumn("owner", F.last(F.when(F.col("level") != 88, F.col("line_no")), True).over(in_record))
    told = F.concat(F.col("name"), F.coalesce(F.concat(F.lit("="), F.regexp_replace(group(t, _VALUE), r"\.$", "")), F.lit("")))
    folded = e.where("level = 88").groupBy("path", F.col("owner").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), told.alias("told")))), lambda c: c["told"]), "|").alias("conditions")
    )
    fields = e.where("level <> 88")
    first = Window.partitionBy("path", "record_line").orderBy("line_no")
    # for each level the last entry so far; the group is the latest of those at lower levels
    last_at = [F.last(F.when(F.col("level") == k, F.struct("line_no", "name")), True).over(first.rowsBetween(_UP_TO, -1)) for k in (*range(1, 50), 66, 77)]
    levels = F.array(*(F.lit(k) for k in (*range(1, 50), 66, 77)))
    held = F.zip_with(levels, F.col("lasts"), lambda k, x: F.when(k < F.col("level"), x))
    fields = fields.withColumn("lasts", F.array(*last_at)).withColumn("group", F.array_max(held))
    fields = fields.withColumn("record", F.first("name").over(first.rowsBetween(_UP_TO, 0)))
    low, high, on = (group(t, any_case(OCCURS), k) for k in (1, 2, 3))
    high = F.coalesce(high, low)
    span = F.when(low == high, F.concat(low, F.lit(" TIMES"))).otherwise(F.concat(low, F.lit(" TO "), high, F.lit(" TIMES")))
    occurs = F.concat(span, F.coalesce(F.concat(F.lit(" DEPENDING ON "), F.upper(on)), F.lit("")))
    return fields.join(folded, ["path", "line_no"], "left").select(
        "path", "line_no", "end_line", "holder", "record", "level", "name", group(t, _PICTURE).alias("pic"), F.upper(group(t, any_case(REDEFINES))).alias("redefines"),
        occurs.alias("occurs"), low.alias("occurs_min"), high.alias("occurs_max"), F.upper(on).alias("depending_on"), F.col("group.name").alias("group_name"), "conditions",
    )


def file_descriptions(files: DataFrame) -> DataFrame:
    """(path, line_no, name, dd_name) of FD entries, with the DD name that SELECT assigns."""
    own = strip_comments(lines(files))
    fd = own.select("path", "line_no", F.upper(group(F.col("line"), any_case(r"^\s*FD\s+([A-Za-z][\w-]*)"))).alias("name")).where("name is not null")
    plain = files.select("path", without_comments(F.col("text")).alias("text"))
    assigned = located(plain, any_case(SELECT_ASSIGN), {"logical": 1, "dd": 2})
    last = assigned.groupBy("path", F.upper("logical").alias("name")).agg(F.max_by(F.upper("dd"), "number").alias("dd_name"))
    return fd.join(last, ["path", "name"], "left").select("path", "line_no", "name", "dd_name")


def programs(files: DataFrame) -> DataFrame:
    """(path, program, n_lines, using): using, the names of PROCEDURE DIVISION USING, is null for a program that isn't callable."""
    using = group(without_comments(F.col("text")), "(?im)" + PROCEDURE_USING)
    words = F.array_join(F.filter(F.split(using, r"[\s,]+"), lambda x: x != ""), " ")
    return files.select("path", program_name(F.col("path"), F.col("text")).alias("program"), F.size(F.split("text", "\n", -1)).alias("n_lines"), F.nullif(words, F.lit("")).alias("using"))


def graph_of(files: DataFrame, books: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of programs (path, text): structure, data descriptions, performs, calls, SQL, CICS and file access.

    A statement hangs under the paragraph that holds it, else under its program; file access reaches described files
    only, by the record's file for WRITE and REWRITE. Of nodes with one id the last stands, edges are told once.
    """
    files = expanded(files, books)
    own = programs(files)
    text = files.join(own.select("path", "program"), "path")
    name = text.select("path", "program")
    source = lines(files)
    # facts are compact and used many times: each is written once
    spans = cut(cobol_spans(source).join(name, "path"))
    raw = F.array_join(F.slice(F.split("text", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    spans_text = spans.join(files, "path")
    items = cut(data_items(files).join(name, "path"))
    described = file_descriptions(files).join(name, "path")
    said = cut(in_paragraph(statements(files), spans.drop("program")).join(name, "path"))
    node = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *(F.col(p) if isinstance(p, str) else p for p in parts))
    under = F.when(F.col("paragraph").isNotNull(), node("paragraph", "program", "paragraph")).otherwise(node("program", "program"))
    at = lambda line: F.concat_ws(":", "path", F.col(line))
    pairs = lambda *kv: F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in kv)), F.array(*(v.cast("string") for _, v in kv))), lambda _, v: v.isNotNull())
    blank = F.lit(None).cast("string")

    record = F.col("level") == 1
    item_id = F.when(record, node("record", "program", "record")).otherwise(node("field", "program", "record", "name"))
    level = F.lpad(F.col("level").cast("string"), 2, "0")
    inner = F.col("group_name").isNotNull() & (F.col("group_name") != F.col("record"))
    item_attributes = pairs(
        ("level", level), ("pic", F.when(~record, F.col("pic"))), ("redefines", F.col("redefines")), ("occurs", F.col("occurs")), ("occurs_min", F.col("occurs_min")),
        ("occurs_max", F.col("occurs_max")), ("depending_on", F.col("depending_on")), ("parent_group", F.when(~record & inner, F.col("group_name"))), ("condition_values", F.col("conditions")),
    )
    sql, cics, call = (said.where(F.col("op") == op) for op in ("sql", "cics", "call"))
    counted = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1)
    block = lambda kind: node(kind, "program", F.col("n").cast("string"), F.col("line_no").cast("string"))
    call_id = node("external_call", "program", "target", F.col("line_no").cast("string"))
    nodes = union_all([
        node_rows(own, node("program", "program"), F.lit("program"), F.col("program"), F.lit(1), F.col("n_lines"), blank,
                  pairs(("language", F.lit("cobol")), ("callable", F.when(F.col("using").isNotNull(), F.lit("true"))), ("linkage_using", F.col("using")))),
        node_rows(spans_text, F.concat_ws(":", "kind", "program", "name"), F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line"), raw),
        node_rows(described, node("file", "program", "name"), F.lit("file"), F.col("name"), F.col("line_no"), F.col("line_no"), blank, pairs(("dd_name", F.col("dd_name")))),
        node_rows(items, item_id, F.when(record, "record").otherwise("field"), F.col("name"), F.col("line_no"), F.col("end_line"), blank, item_attributes),
        node_rows(call, call_id, F.lit("external_call"), F.col("target"), F.col("line_no"), F.col("line_no"), blank, pairs(("target", F.col("target")), ("call_style", F.lit("literal")))),
        *(node_rows(counted(df), block(kind), F.lit(kind), F.concat(F.lit(prefix), "target"), F.col("line_no"), F.col("end_line"), F.col("body"), pairs(("verb", F.col("target"))))
          for df, kind, prefix in ((sql, "sql_block", "SQL-"), (cics, "txn_call", "CICS-"))),
    ])
    section = F.when((F.col("kind") == "paragraph") & F.col("section").isNotNull(), node("section", "program", "section")).otherwise(node("program", "program"))
    holder = F.when(F.col("holder").isNotNull(), node("file", "program", "holder")).otherwise(node("program", "program"))
    group_id = F.when(inner, node("field", "program", "record", "group_name")).otherwise(node("record", "program", "record"))
    named = spans.where("kind = 'paragraph'").select("path", F.col("name").alias("target")).distinct()
    performed = said.where("op = 'perform' and paragraph is not null").join(named, ["path", "target"], "left_semi")
    # the file of the last 01 of a name
    of_record = items.where("level = 1 and holder is not null").groupBy("path", F.col("record").alias("target")).agg(F.max_by("holder", "line_no").alias("holder"))
    verbs = said.where(F.col("op").isin("read", "write", "rewrite", "delete")).join(of_record, ["path", "target"], "left")
    verbs = verbs.withColumn("file", F.when(F.col("op").isin("write", "rewrite"), F.coalesce("holder", "target")).otherwise(F.col("target")))
    verbs = verbs.join(described.select("path", F.col("name").alias("file")).distinct(), ["path", "file"], "left_semi")
    # a redefined name must stand before: a field of the record, else a record
    seen = items.groupBy("path", F.when(record, F.lit(None)).otherwise(F.col("record")).alias("in_record"), F.col("name").alias("redefines")).agg(F.min("line_no").alias("seen"))
    over = items.where("redefines is not null")
    fields, records = (seen.where(c).withColumnRenamed("seen", s) for c, s in (("in_record is not null", "field_seen"), ("in_record is null", "record_seen")))
    over = over.join(fields.withColumnRenamed("in_record", "record"), ["path", "record", "redefines"], "left").join(records.drop("in_record"), ["path", "redefines"], "left")
    target = F.when(F.col("field_seen") < F.col("line_no"), node("field", "program", "record", "redefines")).when(F.col("record_seen") < F.col("line_no"), node("record", "program", "redefines"))
    edges = union_all([
        edge_rows(spans, section, F.concat_ws(":", "kind", "program", "name"), F.lit("contains"), at("start_line"), F.col("start_line")),
        edge_rows(described, node("program", "program"), node("file", "program", "name"), F.lit("contains"), F.concat(at("line_no"), F.lit(" FD")), F.col("line_no")),
        edge_rows(items, F.when(record, holder).otherwise(group_id), item_id, F.lit("contains"), at("line_no"), F.col("line_no")),
        edge_rows(over.where(target.isNotNull()), item_id, target, F.lit("redefines"), F.concat(F.lit("REDEFINES "), "redefines"), F.col("line_no")),
        edge_rows(performed, under, node("paragraph", "program", "target"), F.lit("performs"), at("line_no"), F.col("line_no")),
        edge_rows(call, under, call_id, F.lit("calls"), at("line_no"), F.col("line_no")),
        edge_rows(counted(sql), under, block("sql_block"), F.when(F.col("target").isin(*READING_VERBS), "reads").otherwise("writes"), at("line_no"), F.col("line_no")),
        edge_rows(counted(cics), under, block("txn_call"), F.lit("calls"), at("line_no"), F.col("line_no")),
        edge_rows(verbs, under, node("file", "program", "file"), F.when(F.col("op") == "read", "reads").otherwise("writes"), F.concat_ws(" ", at("line_no"), F.upper("op")), F.col("line_no")),
    ])
    return nodes, edges


def data_dictionary(nodes: DataFrame) -> DataFrame:
    """(program, record, field, level, pic, redefines, occurs, conditions, group_name) of field nodes, empty where there is nothing."""
    a = lambda k: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    part = lambda n: F.split_part("id", F.lit(":"), F.lit(n))
    return nodes.where("kind = 'field'").select(
        part(2).alias("program"), part(3).alias("record"), F.col("name").alias("field"), F.when(a("level") == "", "?").otherwise(a("level")).alias("level"), a("pic").alias("pic"),
        a("redefines").alias("redefines"), a("occurs").alias("occurs"), a("condition_values").alias("conditions"), a("parent_group").alias("group_name"),
    )


def dictionary_text(dictionary: DataFrame) -> DataFrame:
    """(program, text): a Markdown table a program, by record and field."""
    shown = ("pic", "redefines", "occurs", "conditions", "group_name")
    cell = lambda c: F.when(F.col(c) != "", F.concat(F.lit("`"), F.col(c), F.lit("`"))).otherwise("—")
    sure = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", sure("record"), sure("field"), sure("level"), *map(cell, shown)), F.lit(" |"))
    heads = ("Record", "Field", "Level", "PIC", "REDEFINES", "OCCURS", "Conditions (88)", "Group")
    top = "| " + " | ".join(heads) + " |\n| " + " | ".join("---" for _ in heads) + " |\n"
    ordered = F.array_sort(F.collect_list(F.struct("record", "field", row.alias("row"))))
    return dictionary.groupBy("program").agg(F.concat(F.lit(top), F.array_join(F.transform(ordered, lambda x: x["row"]), "\n")).alias("text"))
