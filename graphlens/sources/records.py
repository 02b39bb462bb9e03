"""Service records as DataFrames: JSON lines, JSON works, article XML, id lists, mappings, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import text as X

#: Staged paper record; unknown keys are dropped by the projection.
PAPER_RECORD = "source string, doi string, s2_id string, oa_id string, title string, year int, authors array<string>, venue string, abstract string, pub_type string, cit_count int, ref_count int, extra_identifiers map<string,array<string>>"
CITATION_RECORD = "source string, citing_doi string, citing_s2_id string, citing_oa_id string, cited_doi string, cited_s2_id string, cited_oa_id string"
#: Categories that a tag may have.
CATEGORIES = ("topic", "method", "species", "gene", "place", "other")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped; malformed lines are dropped."""
    df = spark.read.schema(f"{schema}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    return df.where("__bad is null").drop("__bad")


def parse_records(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Records of a JSON text column; unparsable rows are dropped."""
    return lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


#: Schema of an open-catalogue work.
WORK = "id string, doi string, title string, publication_year int, publication_date string, type string, ids struct<pmid:string>, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, abstract_inverted_index map<string,array<int>>, cited_by_count int, referenced_works array<string>, open_access struct<is_oa:boolean>, is_retracted boolean"


def parse_works(lines: DataFrame, column: str = "value") -> DataFrame:
    """Paper columns of open-catalogue works."""
    w = parse_records(lines, WORK, column)
    return w.select(
        X.work_id(F.col("id")).alias("oa_id"), X.normalise_doi(F.col("doi")).alias("doi"), X.id_tail(F.col("ids.pmid")).alias("pubmed_id"), X.clean_title(F.col("title")).alias("title"),
        F.col("publication_year").alias("year"), "publication_date", X.month_of(F.col("publication_date")).alias("month"), F.col("type").alias("pub_type"),
        F.array_compact(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.col("primary_location.source.display_name").alias("venue"),
        F.col("biblio.volume").alias("volume"), F.col("biblio.issue").alias("issue"), F.col("biblio.first_page").alias("first_page"), F.col("biblio.last_page").alias("last_page"),
        X.rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.col("cited_by_count").alias("cit_count"), F.size("referenced_works").alias("ref_count"),
        F.col("open_access.is_oa").cast("int").alias("is_open_access"), F.when(F.col("is_retracted"), "retracted").alias("editorial_status"),
        F.transform("referenced_works", X.work_id).alias("references"),
    )


#: Schema of a registration-agency message.
MESSAGE = "DOI string, title array<string>, type string, `container-title` array<string>, volume string, issue string, page string, publisher string, author array<struct<family:string,given:string,name:string>>, editor array<struct<family:string,given:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` int"


def parse_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Paper columns of registration-agency messages."""
    m = parse_records(lines, MESSAGE, column)
    pages = F.split("page", "-", 2)
    return m.select(
        X.normalise_doi(F.col("DOI")).alias("doi"), X.clean_title(F.get("title", 0)).alias("title"), F.col("type").alias("pub_type"), F.get(F.col("`container-title`"), 0).alias("venue"),
        "volume", "issue", F.get(pages, 0).alias("first_page"), F.get(pages, 1).alias("last_page"), "publisher", X.join_names(F.col("author")).alias("authors"), X.join_names(F.col("editor")).alias("editors"),
        F.get(F.get(F.col("issued.`date-parts`"), 0), 0).alias("year"), F.col("`is-referenced-by-count`").alias("cit_count"),
    )


#: Schema of a scholar-graph paper.
SCHOLAR = "paperId string, corpusId long, title string, year int, venue string, journal struct<name:string,volume:string,pages:string>, abstract string, publicationTypes array<string>, externalIds map<string,string>, authors array<struct<name:string>>, citationCount int, referenceCount int, influentialCitationCount int, isOpenAccess boolean, references array<struct<paperId:string,externalIds:map<string,string>>>, citations array<struct<paperId:string,externalIds:map<string,string>>>"
#: Fixed value: schemes of external identifiers.
SCHEMES = {"DOI": "doi", "PubMed": "pmid", "PubMedCentral": "pmcid", "ArXiv": "arxiv", "MAG": "mag", "ACL": "acl", "DBLP": "dblp", "CorpusId": "corpusid"}


def external_ids(c: Column) -> Column:
    """External identifiers under their schemes; unknown ones in lower case."""
    names = F.create_map(*(F.lit(x) for kv in SCHEMES.items() for x in kv))
    return F.transform_keys(c, lambda k, v: F.coalesce(F.element_at(names, k), F.lower(k)))


def parse_scholar(lines: DataFrame, column: str = "value") -> DataFrame:
    """Paper columns of scholar-graph papers."""
    s = parse_records(lines, SCHOLAR, column)
    ids = external_ids(F.col("externalIds"))
    return s.select(
        F.col("paperId").alias("s2_id"), X.normalise_doi(F.element_at(ids, "doi")).alias("doi"), F.element_at(ids, "pmid").alias("pubmed_id"), X.clean_title(F.col("title")).alias("title"), "year",
        F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.col("journal.name")).alias("venue"), F.col("journal.volume").alias("volume"), X.split_pages(F.col("journal.pages"))["first"].alias("first_page"),
        "abstract", F.get("publicationTypes", 0).alias("pub_type"), F.transform("authors", lambda a: a["name"]).alias("authors"), F.col("citationCount").alias("cit_count"), F.col("referenceCount").alias("ref_count"),
        F.col("isOpenAccess").cast("int").alias("is_open_access"), ids.alias("identifiers"),
        F.transform("references", lambda r: r["paperId"]).alias("references"), F.transform("citations", lambda r: r["paperId"]).alias("citers"),
    )


def citation_edges(works: DataFrame, key: str, references: str = "references", citers: str | None = None) -> DataFrame:
    """``(citing, cited)`` from work to reference and, reversed, from citer to work."""
    out = works.select(F.col(key).alias("citing"), F.explode(references).alias("cited"))
    if citers is not None:
        out = out.unionAll(works.select(F.explode(citers).alias("citing"), F.col(key).alias("cited")))
    return out.where("citing is not null and cited is not null").distinct()


def present_marks(records: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``(key, field, status)``: a wanted field succeeded where it came back non-empty, else failed."""
    full = lambda f: F.col(f).isNotNull() & (F.length(F.col(f).cast("string")) > 0)
    marks = F.array(*(F.struct(F.lit(f).alias("field"), F.when(full(f), "succeeded").otherwise("failed").alias("status")) for f in fields))
    return records.select(key, F.explode(marks).alias("m")).select(key, "m.*")


def settle(items: DataFrame, works: DataFrame, on: str) -> DataFrame:
    """Wanted ``items(paper_id, field, <on>)`` against fetched works: succeeded where the field is there, else failed."""
    fields = [f for f in works.columns if f != on]
    vals = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)))
    have = works.select(F.upper(on).alias("__k"), vals.alias("__have")).groupBy("__k").agg(F.flatten(F.collect_list("__have")).alias("__have"))
    ok = F.coalesce(F.when(F.col("field") == "_all", F.col("__have").isNotNull()).otherwise(F.array_contains("__have", F.col("field"))), F.lit(False))
    return items.join(have, F.upper(on) == F.col("__k"), "left").select("paper_id", "field", F.when(ok, "succeeded").otherwise("failed").alias("status"))


ARTICLE = "MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>, Journal:struct<Title:string, JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string,MedlineDate:string>>>, Pagination:struct<MedlinePgn:string>, AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string>>>>, CommentsCorrectionsList:struct<CommentsCorrections:array<struct<_RefType:string,PMID:string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article XML: labelled abstract sections joined by newlines, ids, and whether a retraction refers to it."""
    x = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path)
    a = F.col("MedlineCitation.Article")
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    part = lambda s: F.concat_ws(": ", s["_Label"], s["_VALUE"])
    name = lambda p: F.coalesce(F.nullif(F.concat_ws(", ", p["LastName"], p["ForeName"]), F.lit("")), p["CollectiveName"])
    pages = F.split(a["Pagination"]["MedlinePgn"], "-", 2)
    date = a["Journal"]["JournalIssue"]["PubDate"]
    refs = F.col("MedlineCitation.CommentsCorrectionsList.CommentsCorrections")
    return x.select(
        F.col("MedlineCitation.PMID").alias("pubmed_id"), X.normalise_doi(F.get(F.filter(ids, lambda i: i["_IdType"] == "doi"), 0)["_VALUE"]).alias("doi"), X.clean_title(a["ArticleTitle"]).alias("title"),
        F.nullif(F.array_join(F.transform(a["Abstract"]["AbstractText"], part), "\n"), F.lit("")).alias("abstract"), a["Journal"]["Title"].alias("venue"), X.year_of(F.coalesce(date["Year"], date["MedlineDate"])).alias("year"),
        a["Journal"]["JournalIssue"]["Volume"].alias("volume"), F.get(pages, 0).alias("first_page"), F.get(pages, 1).alias("last_page"), F.transform(a["AuthorList"]["Author"], name).alias("authors"),
        F.coalesce(F.exists(refs, lambda r: r["_RefType"] == "RetractionIn"), F.lit(False)).alias("retracted"),
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id`` of a JSON list, of ``{"ids": [...]}`` or of ``{"papers": [{"id": ...}]}``."""
    t = spark.read.text(path, wholetext=True)
    lists = F.coalesce(F.from_json("value", "array<long>"), F.from_json("value", "ids array<long>")["ids"], F.transform(F.from_json("value", "papers array<struct<id:long>>")["papers"], lambda p: p["id"]))
    return t.select(F.explode(lists).alias("id")).distinct()


def read_tag_categories(spark: SparkSession, path: str) -> DataFrame:
    """``(tag, category)`` of a tab-separated file; blank lines are skipped, an unknown category is an error."""
    df = spark.read.option("sep", "\t").schema("tag string, category string").csv(path).where("tag is not null")
    ok = F.col("category").isin(*CATEGORIES)
    return df.select("tag", F.when(ok, F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("")))).cast("string")).alias("category"))


def apply_categories(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """A category belongs to the tag: it goes to all the tag's rows."""
    return tags.drop("category").join(mapping, "tag", "left").select("paper_id", "tag", "category")


def edit_tags(tags: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Tags after removals, then additions that are not there yet; a known category spreads to the tag's rows."""
    out = tags.select("paper_id", "tag", "category")
    if remove is not None:
        out = out.join(remove.select("paper_id", "tag"), ["paper_id", "tag"], "left_anti")
    if add is not None:
        out = out.unionByName(add.select("paper_id", "tag", "category").join(out, ["paper_id", "tag"], "left_anti").dropDuplicates(["paper_id", "tag"]))
    known = out.groupBy("tag").agg(F.max("category").alias("category"))
    return out.drop("category").join(known, "tag").select("paper_id", "tag", "category")


def snapshot(papers: DataFrame, edges: DataFrame, vectors: DataFrame, path: str) -> dict:
    """Bundle of the node set: papers, edges, vectors and node index as Parquet, and a manifest as JSON."""
    from graphlens.operators.components import number_rows
    from graphlens.operators.graph import node_set, within

    spark = papers.sparkSession
    nodes = node_set(papers).join(vectors.select(F.col("node_id").alias("__v")).distinct(), F.col("id") == F.col("__v"), "left")
    nodes = nodes.withColumn("structural", F.col("__v").isNull().cast("int")).drop("__v")
    index = number_rows(nodes.select("id", "structural", "year"), ["structural", "id"], "node_id")
    index.write.mode("overwrite").parquet(f"{path}/nodes")
    index = spark.read.parquet(f"{path}/nodes")
    kept = within(edges, index)
    kept.write.mode("overwrite").parquet(f"{path}/edges")
    vectors.join(index.where("structural = 0").select(F.col("id").alias("node_id"), F.col("node_id").alias("row")), "node_id").select("row", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    total, n = edges.count(), spark.read.parquet(f"{path}/edges").count()
    years = index.agg(F.min("year"), F.max("year"), F.count_if(F.col("year").isNull())).first()
    manifest = {"nodes": index.count(), "embedded": index.where("structural = 0").count(), "edges": n, "edges_percent": 100 * n / total if total else 0.0, "year_min": years[0], "year_max": years[1], "year_null": years[2]}
    spark.createDataFrame([manifest], "nodes long, embedded long, edges long, edges_percent double, year_min int, year_max int, year_null long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def subset(papers: DataFrame, edges: DataFrame, vectors: DataFrame, predicate: Column, path: str) -> dict:
    """Bundle of the selected part of the node set; selected papers without a vector become structural."""
    return snapshot(papers.where(predicate), edges, vectors, path)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Copies of whole tables, each under its name; a reader sees a table only once it is complete."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def subset_index(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of all bundles under ``path`` with their folder."""
    return spark.read.json(f"{path}/*/manifest").withColumn("bundle", F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest/", 1))


def write_map(pairs: DataFrame, path: str) -> None:
    """Tab-separated map; Spark's committer renames whole files into place."""
    pairs.write.mode("overwrite").option("sep", "\t").csv(path)
