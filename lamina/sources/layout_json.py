"""Layout JSON (version 2.0): pages of placed blocks as rows, and the same rows as JSON again; the document model beside the pages as rows of elements.

Styles and media are dictionaries of a document; blocks and elements name them by number, and rows get what is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks keep their content as text; a content that is an object stays its JSON.
BLOCK = "struct<f:array<double>,t:string,s:int,m:int,c:string,uid:string,seq:int>"
SCHEMA = f"version string, format string, styles array<string>, media array<string>, pages array<struct<n:int,size:array<double>,margins:array<double>,blocks:array<{BLOCK}>,h:array<{BLOCK}>,f:array<{BLOCK}>>>"
PARTS = {"body": "blocks", "header": "h", "footer": "f"}


def scan(rows: DataFrame, key: str = "doc_id", column: str = "json") -> DataFrame:
    """(key, page, width, height, part, idx, kind, x, y, w, h, style, media, text, uid, seq): a row a block; text that is no such JSON has none. ``style`` and ``media`` are JSON."""
    read = rows.select(key, F.from_json(column, SCHEMA).alias("j")).select(key, F.col("j.styles").alias("styles"), F.col("j.media").alias("media"), F.explode("j.pages").alias("p"))
    empty = F.array().cast(f"array<{BLOCK}>")

    def of(part: str, name: str) -> Column:
        return F.transform(F.coalesce(F.col(f"p.{name}"), empty), lambda b, i: F.struct(F.lit(part).alias("part"), i.alias("idx"), b.alias("b")))

    tagged = F.concat(*(of(part, name) for part, name in PARTS.items()))
    found = read.select(key, "styles", "media", "p", F.inline(tagged))
    frame = [F.get(F.col("b.f"), i).alias(n) for i, n in enumerate("xywh")]
    return found.select(
        key, F.col("p.n").alias("page"), F.get(F.col("p.size"), 0).alias("width"), F.get(F.col("p.size"), 1).alias("height"), "part", "idx", F.col("b.t").alias("kind"), *frame,
        F.get("styles", F.col("b.s")).alias("style"), F.get("media", F.col("b.m")).alias("media"), F.col("b.c").alias("text"), "b.uid", "b.seq",
    )


#: An element of the model; tables hold rows of cells, whose texts are read.
RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size:string,color:string>"
ELEMENT = f"struct<type:string,id:string,text:string,m:int,path:string,rel_id:string,width:double,height:double,runs:array<{RUN}>,list:struct<level:int,numbering_id:string>,style:string,rows:array<struct<cells:array<struct<text:string>>>>>"
MODEL = f"media array<string>, body array<{ELEMENT}>, headers map<string,array<{ELEMENT}>>, footers map<string,array<{ELEMENT}>>"


def model(rows: DataFrame, key: str = "doc_id", column: str = "json") -> DataFrame:
    """(key, part, rel, seq, kind, row_idx, col_idx, text, n_runs, num_id, level, style, path, media_rel): a row for each element of the body and of each header and footer
    (``rel``: its relationship), and for each cell of a table.

    An image has the path and relationship of its entry in the dictionary of media, or else its own. A paragraph without a text has that of its runs.
    """
    read = rows.select(key, F.from_json(column, MODEL).alias("j"))
    none = F.array().cast(f"array<{ELEMENT}>")
    whole = F.array(F.struct(F.lit("body").alias("part"), F.lit(None).cast("string").alias("rel"), F.coalesce("j.body", none).alias("own")))
    owned = lambda part: lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("rel"), F.coalesce(e["value"], none).alias("own"))
    for part in ("header", "footer"):
        entries = F.coalesce(F.map_entries(f"j.{part}s"), F.array().cast(f"array<struct<key:string,value:array<{ELEMENT}>>>"))
        whole = F.concat(whole, F.transform(entries, owned(part)))
    found = read.select(key, F.col("j.media").alias("_media"), F.inline(whole)).select(key, "_media", "part", "rel", F.posexplode("own").alias("seq", "e"))
    entry = F.from_json(F.get("_media", F.col("e.m")), "path string, rel_id string")
    found = found.withColumn("_m", entry)
    cells = F.flatten(F.transform("e.rows", lambda r, i: F.transform(r["cells"], lambda c, k: F.struct(i.alias("row_idx"), k.alias("col_idx"), c["text"].alias("text")))))
    one = F.array(F.struct(F.lit(None).cast("int").alias("row_idx"), F.lit(None).cast("int").alias("col_idx"), F.coalesce("e.text", F.array_join(F.col("e.runs.text"), "")).alias("text")))
    table = F.col("e.type") == "table"
    spread = found.select(key, "part", "rel", "seq", "e", "_m", F.inline(F.when(table, F.coalesce(cells, F.array().cast("array<struct<row_idx:int,col_idx:int,text:string>>"))).otherwise(one)))
    return spread.select(
        key, "part", "rel", "seq", F.when(table, "cell").otherwise(F.col("e.type")).alias("kind"), "row_idx", "col_idx", "text", F.size(F.coalesce("e.runs", F.array().cast(f"array<{RUN}>"))).alias("n_runs"), F.col("e.list.numbering_id").alias("num_id"), F.col("e.list.level").alias("level"),
        F.col("e.style").alias("style"), F.coalesce("_m.path", "e.path").alias("path"), F.coalesce("_m.rel_id", "e.rel_id").alias("media_rel"),
    )


def written(blocks: DataFrame, size: tuple[float, float] = (595.0, 842.0), margins: tuple[float, ...] = (72.0, 72.0, 72.0, 72.0)) -> DataFrame:
    """(doc_id, json) of blocks (doc_id, page, part, seq, kind, x, y, w, h, style, text, and media if there are any): styles and media numbered by first appearance, headers and
    footers apart from the body.

    A document's blocks meet in one task. A page that has no block at all isn't written.
    """
    blocks = blocks if "media" in blocks.columns else blocks.withColumn("media", F.lit(None).cast("string"))
    order = ("seq", "kind", "x", "y", "w", "h", "style", "text", "media")
    blocks = blocks.withColumn("style", F.coalesce("style", F.lit("{}"))).repartition("doc_id")  # one exchange serves both groupings
    lists = {name: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct(*order)))).alias(name) for part, name in PARTS.items()}
    pages = blocks.groupBy("doc_id", "page").agg(*lists.values())
    styles = F.array_distinct(F.flatten(F.transform("all", lambda p: F.concat(*(p[name]["style"] for name in PARTS.values())))))
    media = F.array_distinct(F.filter(F.flatten(F.transform("all", lambda p: F.concat(*(p[name]["media"] for name in PARTS.values())))), lambda m: m.isNotNull()))
    own = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", *PARTS.values()))).alias("all")).withColumns({"styles": styles, "media": media})

    def of(b):
        return F.struct(
            F.array(b["x"], b["y"], b["w"], b["h"]).alias("f"), b["kind"].alias("t"), (F.array_position("styles", b["style"]) - 1).cast("int").alias("s"), (F.array_position("media", b["media"]) - 1).cast("int").alias("m"), b["text"].alias("c"),
            F.concat_ws("-", F.lit("b"), b["seq"].cast("string")).alias("uid"), b["seq"].alias("seq"),
        )

    def page(p):
        return F.struct(p["page"].alias("n"), F.array(*map(F.lit, size)).alias("size"), F.array(*map(F.lit, margins)).alias("margins"), *(F.transform(p[name], of).alias(name) for name in PARTS.values()))

    whole = F.struct(F.lit("2.0").alias("version"), F.lit("pipeline").alias("format"), "styles", "media", F.transform("all", page).alias("pages"))
    return own.select("doc_id", F.to_json(whole).alias("json"))
