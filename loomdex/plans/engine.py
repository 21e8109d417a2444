"""Statements of the dialect, run as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators import search as s
from loomdex.operators import where as w
from loomdex.plans import dialect as d
from loomdex.schema import Collection


@dataclass
class Engine:
    """A collection's documents, and postings if there are any. Ranking works on ids, relevance and attributes; texts are joined after the
    limit, for the rows that are returned."""

    docs: DataFrame
    collection: Collection
    postings: DataFrame | None = None
    options: s.Options | None = None

    def found(self, statement: d.Statement) -> DataFrame:
        """Ids, attributes and relevance of all documents that match text and condition."""
        plan = s.Plan(statement.text, self.collection, s.with_stems(self.docs, statement.text, self.collection, self.options))
        attributes = [c for c in self.docs.columns if c not in {f.name for f in self.collection.fields}]
        if self.postings is None:
            rows = self.docs if statement.where is None else self.docs.where(w.column(statement.where, self.collection.enums))
            rows = plan.scan(rows).withColumn("relevance", plan.relevance).where(plan.match)
            return rows.select(*attributes, "relevance")
        hit = plan.index(self.postings).withColumn("relevance", plan.relevance).where(plan.match).select(self.collection.id_col, "relevance")
        rows = self.docs.select(*attributes).join(hit, self.collection.id_col)
        return rows if statement.where is None else rows.where(w.column(statement.where, self.collection.enums))

    def _keys(self, order: tuple[d.Order, ...], last: str) -> list[Column]:
        names = [(F.col("relevance" if o.key.upper() == "RELEVANCY" else o.key), o.descending) for o in order]
        return [c.desc() if desc else c.asc() for c, desc in names] + [F.col(last).asc()]

    def _limited(self, rows: DataFrame, limit: d.Limit | None) -> DataFrame:
        if limit is None:
            return rows
        return rows.offset(limit.offset).limit(limit.count) if limit.offset else rows.limit(limit.count)

    def members(self, rows: DataFrame, group: d.Group) -> DataFrame:
        """Rows of virtual documents, with rank (from 1) within each, as the member limit leaves them."""
        rows = rows if group.where is None else rows.where(w.column(group.where, self.collection.enums))
        by = Window.partitionBy(group.attr).orderBy(*self._keys(group.order, self.collection.id_col))
        rows = rows.withColumn("rank", F.row_number().over(by))
        if group.member_limit is None:
            return rows
        return rows.where((F.col("rank") > group.member_limit.offset) & (F.col("rank") <= group.member_limit.offset + group.member_limit.count))

    def groups(self, rows: DataFrame, group: d.Group) -> DataFrame:
        """Virtual documents: attr, relevance (the greatest of its members), size, and members in order, as far as the statement
        limits them: without a member limit none are listed, as a group may hold any number; members() has them as rows."""
        if group.member_limit is None:
            rows = rows if group.where is None else rows.where(w.column(group.where, self.collection.enums))
            none = F.array().cast(f"array<struct<rank:int,{self.collection.id_col}:bigint,relevance:double>>")
            return rows.groupBy(group.attr).agg(F.max("relevance").alias("relevance"), F.count("*").alias("size")).withColumn("docs", none)
        kept = self.members(rows, group)
        each = F.struct("rank", self.collection.id_col, "relevance")
        return kept.groupBy(group.attr).agg(F.max("relevance").alias("relevance"), F.count("*").alias("size"), F.sort_array(F.collect_list(each)).alias("docs"))

    def run(self, source: str) -> DataFrame:
        """Rows of a statement, in order: documents, or virtual documents if it groups."""
        statement = d.parse(source)
        rows = self.found(statement)
        if statement.group:
            grouped = self.groups(rows, statement.group)
            if statement.order or statement.limit:
                grouped = self._limited(grouped.orderBy(*self._keys(statement.order, statement.group.attr)), statement.limit)
            return grouped
        if statement.order or statement.limit:
            rows = self._limited(rows.orderBy(*self._keys(statement.order, self.collection.id_col)), statement.limit)
        wanted = [c for c in self.docs.columns] + ["relevance"] if statement.fields == ("*",) else [*dict.fromkeys([*statement.fields])]
        texts = [f.name for f in self.collection.fields if f.name in wanted]
        if texts:
            late = self.docs.select(F.col(self.collection.id_col).alias("__id"), *texts)
            rows = rows.join(late, F.col(self.collection.id_col) == F.col("__id")).drop("__id")
            if statement.order:
                rows = rows.orderBy(*self._keys(statement.order, self.collection.id_col))
        return rows.select(*wanted)

    def sorted_by(self, rows: DataFrame, how: str, date: str) -> DataFrame:
        """Rows of found() as old clients ask for them: by "hit" (most relevant first), "date" (latest first) or "date_in_order"."""
        keys = {"hit": F.desc("relevance"), "date": F.desc(date), "date_in_order": F.asc(date)}
        if how not in keys:
            raise ValueError(f"no way of sorting is called {how!r}")
        return rows.orderBy(keys[how], self.collection.id_col)

    def count(self, source: str) -> DataFrame:
        """(result_count, parsed_query): documents that match, before any limit."""
        statement = d.parse(source)
        return self.found(statement).agg(F.count("*").alias("result_count")).withColumn("parsed_query", F.lit(d.show(statement.text)))

    def facets(self, source: str, attr: str) -> DataFrame:
        """(attr, count) over all documents that match."""
        return self.found(d.parse(source)).groupBy(attr).agg(F.count("*").alias("count"))
