"""Claims traced on scanned pages: words put into lines, then numbers and texts looked for on the page they are claimed for.

Everything is keyed by (document, page): lines never run over pages, and a value on another page proves nothing. A page is bounded by its paper, so its words make one row; all else are joins and
array functions, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectra.functions import normalise as n
from inspectra.plans.materialise import stored
from inspectra.plans.registry import query
from inspectra.sources.views import ORACLE_VIEWS, VIEWS, frame

c = F.col
PAGE = ["document_id", "page"]
BOX = ["box_left", "box_top", "width", "height"]
#: The reach of a line in parts of the page's height, the most words of a joined number, the least letters of a partial text.
REACH, JOINED, LETTERS = 0.004, 4, 6


def money(text: Column | str) -> Column:
    """The number that is left of a word without its signs and currency."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(30,10)")


def plain(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def lined_pages(words: DataFrame, reach: float = REACH, by: list[str] = PAGE) -> DataFrame:
    """A row a page (by, w): its words in reading order, each with its `line`: a word joins the first line whose first word's centre is within reach, else it begins one.

    An ordered fold over the page's words in the JVM, with the lines' centres as its state."""
    fields = [x for x in words.columns if x not in by]
    # Words are dealt by page before they are gathered: no two words of a page meet earlier, so a partial aggregate would only make them larger.
    pages = words.repartition(*by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("box_top", "box_left", "token", *(x for x in fields if x not in ("box_top", "box_left", "token"))))).alias("w"))
    start = F.struct(F.array().cast("array<double>").alias("centres"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, word: Column) -> Column:
        centre = word["box_top"] + word["height"] / 2
        near = F.array_position(F.transform(state["centres"], lambda x: F.abs(x - centre) <= reach), True).cast("int")
        centres = F.when(near > 0, state["centres"]).otherwise(F.concat(state["centres"], F.array(centre)))
        return F.struct(centres.alias("centres"), F.concat(state["lines"], F.array(F.when(near > 0, near - 1).otherwise(F.size(state["centres"])))).alias("lines"))

    lined = pages.select(*by, "w", F.aggregate("w", start, step, lambda s: s["lines"]).alias("lines"))
    return lined.select(*by, F.zip_with("w", "lines", lambda w, line: F.struct(line.alias("line"), *(w[x].alias(x) for x in fields))).alias("w"))


def page_lines(words: DataFrame, reach: float = REACH, by: list[str] = PAGE) -> DataFrame:
    """Words (by, token, text, box) with `at`, their place in reading order, and `line`."""
    fields = [x for x in words.columns if x not in by]
    each = lined_pages(words, reach, by).select(*by, F.posexplode("w").alias("at", "x"))
    return each.select(*by, *(c(f"x.{x}").alias(x) for x in fields), "at", c("x.line").alias("line"))


def gathered(lines: DataFrame) -> DataFrame:
    """The pages of lined words: `lined_pages` of what `page_lines` gave."""
    word = F.struct("line", "text", *BOX)
    pages = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("at", word.alias("x")))).alias("w"))
    return pages.select(*PAGE, F.transform("w", lambda w: w["x"]).alias("w"))


def _met(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """A row a page that claims are made for: its claims as an array `claims`, and its words `w`, null if it has none. Both sides lie by page, so each is shuffled once."""
    fields = [x for x in claims.columns if x not in PAGE]
    return claims.repartition(*PAGE).groupBy(*PAGE).agg(F.collect_list(F.struct(*fields)).alias("claims")).join(pages.select(*PAGE, "w"), PAGE, "left")


def _around(words: Column) -> Column:
    """The box around an array of words, to five places."""
    edge = lambda f: F.transform(words, f)
    left, top = F.array_min(edge(lambda w: w["box_left"])), F.array_min(edge(lambda w: w["box_top"]))
    right, bottom = F.array_max(edge(lambda w: w["box_left"] + w["width"])), F.array_max(edge(lambda w: w["box_top"] + w["height"]))
    return F.struct(F.bround(left, 5).alias("box_left"), F.bround(top, 5).alias("box_top"), F.bround(F.greatest(F.lit(0.0), right - left), 5).alias("width"), F.bround(F.greatest(F.lit(0.0), bottom - top), 5).alias("height"))


def trace_numbers(claims: DataFrame, lines: DataFrame, most: int = JOINED) -> DataFrame:
    """V1, V2: (page, claim_id, verdict, how, text, box) of number claims (page, claim_id, value).

    A single word of that number comes first, by reading order (`word`); else up to `most` neighbouring words of a line whose joined text is that number (`joined`) or has its digits, a
    decimal point being lost (`digits`), by line, start and length. A null claim agrees; one that is no number is unsupported; a page without words cannot be checked."""
    return numbers_on_pages(claims, gathered(lines), most)


def numbers_on_pages(claims: DataFrame, pages: DataFrame, most: int = JOINED) -> DataFrame:
    """`trace_numbers` over lined pages: words and their runs are looked at once a page, and claims are looked up in the arrays of their numbers and digits."""
    # Signs are taken out of each word by itself: what is left of joined words is what is left of each, joined. Numbers are compared as the text of their decimal; what is none throws as it is read, so its shape is looked at first.
    number = lambda x: F.when(x.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), x.try_cast("decimal(30,10)").cast("string"))
    word = lambda w, i: F.struct(w["line"].alias("line"), i.alias("at"), F.regexp_replace(w["text"], r"[^0-9.\-]", "").alias("money"), n.digits_only(w["text"]).alias("digits"), w["text"].alias("text"), *(w[x].alias(x) for x in BOX))
    rows = _met(claims, pages).withColumn("s", F.sort_array(F.transform("w", word))).select(*PAGE, "claims", "s")
    # Of each word the runs that begin with it, by length; null where the line ends before.
    of = lambda i, k, f: F.concat_ws("", *(F.get(c("s"), i + x)[f] for x in range(k)))
    run = lambda i, k: F.when(F.get(c("s"), i + k - 1)["line"] == F.get(c("s"), i)["line"], F.struct(number(of(i, k, "money")).alias("number"), of(i, k, "digits").alias("digits")))
    rows = rows.withColumn("runs", F.flatten(F.transform("s", lambda w, i: F.array(*(run(i, k) for k in range(2, most + 1))))))
    single = F.sort_array(F.transform("s", lambda w, i: F.struct(w["at"].alias("at"), number(w["money"]).alias("number"), i.alias("i"))))
    rows = rows.withColumn("single", single).select(*PAGE, "claims", "s", F.transform("single", lambda w: w["number"]).alias("single"), F.transform("single", lambda w: w["i"]).alias("spot"), F.transform("runs", lambda x: x["number"]).alias("numbers"), F.transform("runs", lambda x: x["digits"]).alias("digits"))
    each = rows.select(*PAGE, "s", "single", "spot", "numbers", "digits", F.explode("claims").alias("x"))
    wanted = F.when(c("x.value").rlike("[0-9]"), money("x.value").cast("string"))
    each = each.select(*PAGE, "s", "single", "spot", "numbers", "digits", "x.claim_id", "x.value", wanted.alias("_number"), F.nullif(n.digits_only("x.value"), F.lit("")).alias("_digits"))
    place = lambda array, x: F.nullif(F.array_position(array, c(x)), F.lit(0)).cast("int")
    each = each.select(*PAGE, "s", "spot", "claim_id", "value", "_number", place("single", "_number").alias("word"), place("numbers", "_number").alias("joined"), F.when(c("_number").isNotNull(), place("digits", "_digits")).alias("digital"))
    # Of the same words, the number counts before its digits.
    how = F.when(c("word").isNotNull(), "word").when(c("joined").isNotNull() & (c("digital").isNull() | (c("joined") <= c("digital"))), "joined").when(c("digital").isNotNull(), "digits")
    first = F.when(c("how") == "joined", c("joined")).otherwise(c("digital")) - 1
    used = F.when(c("how") == "word", F.slice("s", F.get("spot", c("word") - 1) + 1, F.lit(1))).when(c("how").isNotNull(), F.slice("s", F.floor(first / (most - 1)).cast("int") + 1, first % (most - 1) + 2))
    verdict = F.when(c("value").isNull(), "AGREED").when(c("_number").isNull(), "UNSUPPORTED").when(c("s").isNull(), "MODEL_ONLY").when(c("how").isNotNull(), "AGREED").otherwise("UNSUPPORTED")
    each = each.withColumn("how", how).select(*PAGE, "claim_id", verdict.alias("verdict"), "how", used.alias("used"))
    return each.select(*PAGE, "claim_id", "verdict", "how", F.when(c("used").isNotNull(), F.array_join(F.transform("used", lambda w: w["text"]), "")).alias("text"), F.when(c("used").isNotNull(), _around(c("used"))).alias("box"))


def trace_texts(claims: DataFrame, lines: DataFrame, letters: int = LETTERS) -> DataFrame:
    """V3: (page, claim_id, verdict, how, text, box) of text claims: the first line of the page that holds the claim's letters and digits, or its first `letters`. The box is that
    of the line's words that the claim holds, or of the line without any."""
    return texts_on_pages(claims, gathered(lines), letters)


def texts_on_pages(claims: DataFrame, pages: DataFrame, letters: int = LETTERS) -> DataFrame:
    """`trace_texts` over lined pages: a line's letters are read once a page, and a claim meets the lines of its own page only."""
    word = lambda w: F.struct(w["line"].alias("line"), w["at"].alias("at"), plain(w["x"]["text"]).alias("key"), w["x"]["text"].alias("text"), *(w["x"][x].alias(x) for x in BOX))
    rows = _met(claims, pages).withColumn("w", F.transform(F.sort_array(F.transform("w", lambda w, i: F.struct(w["line"].alias("line"), i.alias("at"), w.alias("x")))), word))
    # Where lines begin is a column of its own: inside the second function it would be looked for again for each line.
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i)["line"] != F.get("w", i - 1)["line"]))
    rows = rows.withColumn("first", begins).withColumn("lines", F.transform("first", lambda i, k: F.slice("w", i + 1, F.coalesce(F.get("first", k + 1), F.size("w")) - i)))
    rows = rows.select(*PAGE, "claims", "lines", F.transform("lines", lambda x: F.array_join(F.transform(x, lambda w: w["key"]), "")).alias("said"))
    each = rows.select(*PAGE, "lines", "said", F.explode("claims").alias("x")).select(*PAGE, "lines", "said", "x.claim_id", "x.value").withColumn("_v", plain(F.coalesce("value", F.lit(""))))
    held = lambda said: (said != "") & (c("_v") != "") & (F.contains(said, c("_v")) | ((F.length("_v") >= letters) & F.contains(said, F.substring("_v", 1, letters))))
    each = each.withColumn("line", F.array_position(F.transform("said", held), True).cast("int"))
    # A verdict asks for the line only, so that who needs no box (V14) has none made.
    each = each.select(*PAGE, "claim_id", "value", "_v", c("said").isNotNull().alias("read"), F.coalesce(c("line") > 0, F.lit(False)).alias("found"), F.when(c("line") > 0, F.get("lines", c("line") - 1)).alias("words"))
    own = F.filter("words", lambda w: (w["key"] != "") & F.contains(c("_v"), w["key"]))
    out = each.withColumn("own", own).select(*PAGE, "claim_id", "value", "_v", "read", "found", F.when(F.size("own") > 0, c("own")).otherwise(c("words")).alias("used"))
    out = out.select("*", F.array_join(F.transform("used", lambda w: w["text"]), " ").alias("text"), F.when(c("used").isNotNull(), _around(c("used"))).alias("box"))
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    verdict = F.when(blank, "AGREED").when(~c("read"), "MODEL_ONLY").when((c("_v") == "") | c("found"), "AGREED").otherwise("UNSUPPORTED")
    return out.select(*PAGE, "claim_id", verdict.alias("verdict"), F.when(c("found"), "line").alias("how"), "text", "box")


def unsupported_quotes(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, claim_id, reason) of present answers (page, claim_id, present, quote) without a quotation, or whose quotation's first 60 characters no line of its page holds."""
    return quotes_on_pages(answers, gathered(lines))


def quotes_on_pages(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """`unsupported_quotes` over lined pages."""
    rows = answers.where("present").withColumn("blank", F.trim(F.coalesce("quote", F.lit(""))) == "")
    seen = texts_on_pages(rows.where("not blank").select(*PAGE, "claim_id", F.substring("quote", 1, 60).alias("value")), pages).where("verdict = 'UNSUPPORTED'")
    return rows.where("blank").select(*PAGE, "claim_id", F.lit("no_quote").alias("reason")).union(seen.select(*PAGE, "claim_id", F.lit("quote_not_found").alias("reason")))


# A register: each line number of an order is a printed row of its document, on one of two pages.
VIEWS["x_printed"] = """
SELECT CAST(l_orderkey AS BIGINT) AS document_id, CAST(1 + l_linenumber % 2 AS INT) AS page, CAST(l_linenumber AS BIGINT) AS line_no, CAST(l_orderkey % 1000 AS BIGINT) AS ok,
       CAST(floor(l_extendedprice) AS BIGINT) AS rupees, CAST(round(l_extendedprice * 100) AS BIGINT) AS paise, CAST(l_quantity AS BIGINT) AS qty, CASE l_partkey % 5 WHEN 0 THEN 'RAM LAL' WHEN 1 THEN 'SITA DEVI' WHEN 2 THEN 'A. K.' WHEN 3 THEN 'MOHAN' ELSE 'LAL' END || CAST(l_suppkey % 50 AS VARCHAR(20)) AS mode, l_returnflag AS flag
FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice, max(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l
"""
VIEWS["x_word"] = """
SELECT document_id, page, line_no * 8 + k AS token, text, CAST(k AS DOUBLE) / 8 AS box_left, CAST(line_no * 8 + (ok + CASE WHEN k = 3 THEN 2 ELSE k END * 5) % 7 AS DOUBLE) / 1024 AS box_top, CAST(0.0625 AS DOUBLE) AS width, CAST(0.0078125 AS DOUBLE) AS height
FROM (SELECT document_id, page, line_no, ok, 0 AS k, 'No.' || CAST(line_no AS VARCHAR(20)) AS text FROM x_printed
      UNION ALL SELECT document_id, page, line_no, ok, 1, replace(mode, ' ', '') FROM x_printed
      UNION ALL SELECT document_id, page, line_no, ok, 2, CASE WHEN rupees >= 1000 THEN CAST((rupees - rupees % 1000) / 1000 AS VARCHAR(20)) || ',' ELSE '' END || CASE WHEN rupees >= 1000 THEN lpad(CAST(rupees % 1000 AS VARCHAR(20)), 3, '0') ELSE CAST(rupees AS VARCHAR(20)) END FROM x_printed
      UNION ALL SELECT document_id, page, line_no, ok, 3, '.' || lpad(CAST(paise % 100 AS VARCHAR(20)), 2, '0') FROM x_printed
      UNION ALL SELECT document_id, page, line_no, ok, 4, CASE WHEN qty % 2 = 0 THEN 'Rs' ELSE '-' END || CAST(qty * 10 AS VARCHAR(20)) FROM x_printed
      UNION ALL SELECT document_id, page, line_no, ok, 5, flag || '/ok' FROM x_printed WHERE qty % 3 <> 0) AS w
"""
VIEWS["x_word"] = VIEWS["x_word"].replace("CAST((rupees - rupees % 1000) / 1000 AS VARCHAR(20))", "CAST(CAST((rupees - rupees % 1000) / 1000 AS BIGINT) AS VARCHAR(20))")
#: Claims about numbers: a printed sum, one that lost its point, a single word, the same on the other page, one on a page that was never read, none, and no number.
VIEWS["x_number_claim"] = """
SELECT document_id, page, line_no * 10 + 1 AS claim_id, CAST(rupees AS VARCHAR(20)) || '.' || lpad(CAST(paise % 100 AS VARCHAR(20)), 2, '0') AS value FROM x_printed
UNION ALL SELECT document_id, page, line_no * 10 + 2, CAST(paise AS VARCHAR(20)) FROM x_printed
UNION ALL SELECT document_id, page, line_no * 10 + 3, CASE WHEN qty % 2 = 0 THEN '' ELSE '-' END || CAST(qty * 10 AS VARCHAR(20)) FROM x_printed
UNION ALL SELECT document_id, CAST(3 - page AS INT), line_no * 10 + 4, CAST(rupees AS VARCHAR(20)) FROM x_printed
UNION ALL SELECT document_id, CAST(9 AS INT), line_no * 10 + 5, CAST(rupees AS VARCHAR(20)) FROM x_printed
UNION ALL SELECT document_id, page, line_no * 10 + 6, CASE WHEN qty % 2 = 0 THEN 'none' END FROM x_printed
"""
VIEWS["x_text_claim"] = """
SELECT document_id, page, line_no * 10 + 1 AS claim_id, lower(mode) || ' ' || CAST(rupees AS VARCHAR(20)) AS value FROM x_printed
UNION ALL SELECT document_id, page, line_no * 10 + 2, mode || '?' || flag FROM x_printed
UNION ALL SELECT document_id, CAST(3 - page AS INT), line_no * 10 + 3, 'no' || CAST(line_no AS VARCHAR(20)) || mode || 'x' FROM x_printed
UNION ALL SELECT document_id, page, line_no * 10 + 4, CASE qty % 4 WHEN 0 THEN ' ' WHEN 1 THEN '?!' WHEN 2 THEN 'nowhere to be found' END FROM x_printed
UNION ALL SELECT document_id, CAST(9 AS INT), line_no * 10 + 5, mode FROM x_printed
"""
ORACLE_VIEWS["x_o_ordered"] = "SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY box_top, box_left, token) - 1 AS spot FROM x_word"
ORACLE_VIEWS["x_o_fold"] = f"""
SELECT document_id, page, list_reduce(list_prepend({{'c': []::DOUBLE[], 'l': []::BIGINT[]}}, list({{'c': [box_top + height / 2], 'l': []::BIGINT[]}} ORDER BY spot)), lambda a, x:
 CASE WHEN coalesce(list_position(list_transform(a.c, lambda y: abs(y - x.c[1]) <= {REACH}), true), 0) > 0 THEN {{'c': a.c, 'l': list_append(a.l, list_position(list_transform(a.c, lambda y: abs(y - x.c[1]) <= {REACH}), true) - 1)}}
 ELSE {{'c': list_append(a.c, x.c[1]), 'l': list_append(a.l, len(a.c)::BIGINT)}} END).l AS lines FROM x_o_ordered GROUP BY 1, 2
"""
ORACLE_VIEWS["x_o_line"] = "SELECT o.*, lines[spot + 1] AS line, row_number() OVER (PARTITION BY document_id, page, lines[spot + 1] ORDER BY spot) AS start FROM x_o_ordered o JOIN x_o_fold f USING (document_id, page)"
ORACLE_VIEWS["x_o_run"] = """
SELECT document_id, page, line, words, plain FROM (SELECT document_id, page, line, list({'text': text, 'l': box_left, 't': box_top, 'r': box_left + width, 'b': box_top + height} ORDER BY spot) AS words,
 regexp_replace(lower(string_agg(text, '' ORDER BY spot)), '[^a-z0-9]', '', 'g') AS plain FROM x_o_line GROUP BY 1, 2, 3)
"""
_EDGES = "round_even(list_min(list_transform(ws, lambda w: w.l)), 5) AS box_left, round_even(list_min(list_transform(ws, lambda w: w.t)), 5) AS box_top, round_even(list_max(list_transform(ws, lambda w: w.r)) - list_min(list_transform(ws, lambda w: w.l)), 5) AS width, round_even(list_max(list_transform(ws, lambda w: w.b)) - list_min(list_transform(ws, lambda w: w.t)), 5) AS height"
_NUMBER = "CASE WHEN regexp_matches({0}, '[0-9]') THEN try_cast(regexp_replace({0}, '[^0-9.\\-]', '', 'g') AS DECIMAL(30, 10)) END"


def _printed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The printed rows that words and claims are made of, worked out once for all of them."""
    return {"x_printed": stored(frame(spark, sf_dir, "x_printed"))}


@query("v16_page_lines", "SELECT document_id, page, token, spot::INT AS spot, line::INT AS line FROM x_o_line")
def _v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    return page_lines(frame(spark, sf_dir, "x_word", printed)).select(*PAGE, "token", c("at").alias("spot"), "line")


@query("v1_v2_page_numbers", rf"""WITH sp AS (SELECT document_id, page, line, start, span, words[start : start + span - 1] AS ws FROM (SELECT r.*, unnest(range(1, len(words) + 1)) AS start FROM x_o_run r), (VALUES (1), (2), (3), (4)) AS s(span) WHERE start + span - 1 <= len(words)),
 pl AS (SELECT sp.*, array_to_string(list_transform(ws, lambda w: w.text), '') AS text FROM sp), nu AS (SELECT pl.*, {_NUMBER.format('pl.text')} AS number, regexp_replace(pl.text, '\D', '', 'g') AS digits, spot FROM pl LEFT JOIN x_o_line l USING (document_id, page, line, start)),
 cl AS (SELECT *, {_NUMBER.format('value')} AS number, regexp_replace(value, '\D', '', 'g') AS digits FROM x_number_claim),
 hit AS (SELECT c.document_id, c.page, c.claim_id, nu.text, ws, CASE WHEN span = 1 THEN 'word' WHEN nu.number = c.number THEN 'joined' ELSE 'digits' END AS how FROM cl c JOIN nu ON nu.document_id = c.document_id AND nu.page = c.page AND c.number IS NOT NULL AND (nu.number = c.number OR (span > 1 AND c.digits <> '' AND nu.digits = c.digits))
  QUALIFY row_number() OVER (PARTITION BY c.document_id, c.page, c.claim_id ORDER BY span > 1, CASE WHEN span = 1 THEN nu.spot ELSE line END, start, span) = 1)
 SELECT cl.document_id, cl.page, cl.claim_id, CASE WHEN value IS NULL THEN 'AGREED' WHEN number IS NULL THEN 'UNSUPPORTED' WHEN NOT EXISTS (SELECT 1 FROM x_word w WHERE w.document_id = cl.document_id AND w.page = cl.page) THEN 'MODEL_ONLY' WHEN how IS NOT NULL THEN 'AGREED' ELSE 'UNSUPPORTED' END AS verdict,
 how, text, {_EDGES} FROM cl LEFT JOIN hit USING (document_id, page, claim_id)""")
def _v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    found = numbers_on_pages(frame(spark, sf_dir, "x_number_claim", printed), lined_pages(frame(spark, sf_dir, "x_word", printed)))
    return found.select(*PAGE, "claim_id", "verdict", "how", "text", "box.*")


@query("v3_page_texts", rf"""WITH cl AS (SELECT *, regexp_replace(lower(coalesce(value, '')), '[^a-z0-9]', '', 'g') AS v FROM x_text_claim),
 hit AS (SELECT cl.document_id, cl.page, claim_id, words, list_filter(words, lambda w: regexp_replace(lower(w.text), '[^a-z0-9]', '', 'g') <> '' AND contains(v, regexp_replace(lower(w.text), '[^a-z0-9]', '', 'g'))) AS own FROM cl JOIN x_o_run r ON r.document_id = cl.document_id AND r.page = cl.page AND plain <> '' AND v <> '' AND (contains(plain, v) OR (length(v) >= 6 AND contains(plain, left(v, 6))))
  QUALIFY row_number() OVER (PARTITION BY cl.document_id, cl.page, claim_id ORDER BY line) = 1), used AS (SELECT document_id, page, claim_id, CASE WHEN len(own) > 0 THEN own ELSE words END AS ws FROM hit)
 SELECT cl.document_id, cl.page, cl.claim_id, CASE WHEN trim(coalesce(value, '')) = '' THEN 'AGREED' WHEN NOT EXISTS (SELECT 1 FROM x_word w WHERE w.document_id = cl.document_id AND w.page = cl.page) THEN 'MODEL_ONLY' WHEN v = '' OR ws IS NOT NULL THEN 'AGREED' ELSE 'UNSUPPORTED' END AS verdict,
 CASE WHEN ws IS NOT NULL THEN 'line' END AS how, CASE WHEN ws IS NOT NULL THEN array_to_string(list_transform(ws, lambda w: w.text), ' ') END AS text, {_EDGES} FROM cl LEFT JOIN used USING (document_id, page, claim_id)""")
def _v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    found = texts_on_pages(frame(spark, sf_dir, "x_text_claim", printed), lined_pages(frame(spark, sf_dir, "x_word", printed)))
    return found.select(*PAGE, "claim_id", "verdict", "how", "text", "box.*")


@query("v14_page_quotes", r"""WITH a AS (SELECT *, regexp_replace(lower(substr(coalesce(value, ''), 1, 60)), '[^a-z0-9]', '', 'g') AS v FROM x_text_claim WHERE claim_id % 7 <> 0)
 SELECT document_id, page, claim_id, CASE WHEN trim(coalesce(value, '')) = '' THEN 'no_quote' ELSE 'quote_not_found' END AS reason FROM a WHERE trim(coalesce(value, '')) = '' OR (v <> '' AND EXISTS (SELECT 1 FROM x_word w WHERE w.document_id = a.document_id AND w.page = a.page)
  AND NOT EXISTS (SELECT 1 FROM x_o_run r WHERE r.document_id = a.document_id AND r.page = a.page AND (contains(plain, v) OR (length(v) >= 6 AND contains(plain, left(v, 6))))))""")
def _v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    answers = frame(spark, sf_dir, "x_text_claim", printed).select(*PAGE, "claim_id", (c("claim_id") % 7 != 0).alias("present"), c("value").alias("quote"))
    return quotes_on_pages(answers, lined_pages(frame(spark, sf_dir, "x_word", printed)))
