"""The inventory domain over the driver's tables: images, sboms, components, dictionary names and review data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.functions.cpe import bind
from bomlens.session import configure


class Domain:
    """Lazy frames of one data directory; columns are pruned by whatever reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def images(self) -> DataFrame:
        joined = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.concat(F.lit("docker.io/library/"), F.lower("n_name")).alias("repository"),
            F.lower("r_name").alias("tag"),
            F.lit("linux/amd64").alias("platform"),
        )

    def sboms(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") != "P", (F.col("c_nationkey") % 23).cast("bigint")).alias("docker_image_id"),
            F.concat(F.lit("sboms/"), F.col("o_orderkey").cast("string"), F.lit(".cdx.json")).alias("source_path"),
            F.col("o_orderdate").alias("imported_at"),
        )

    def names(self) -> DataFrame:
        """The dictionary: one row per official name."""
        part = F.when(F.col("p_size") % 10 == 0, "o").when(F.col("p_size") % 10 == 1, "h").otherwise("a")
        out = self.table("part").select(
            F.col("p_partkey").alias("id"),
            (F.col("p_partkey") % 10 == 0).alias("deprecated"),
            part.alias("part"),
            F.replace(F.lower("p_brand"), F.lit("#"), F.lit("\\#")).alias("vendor"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("product"),
            F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string")).alias("version"),
        )
        name = F.concat(F.lit("cpe:2.3:"), "part", F.lit(":"), "vendor", F.lit(":"), "product", F.lit(":"), "version", F.lit(":*:*:*:*:*:*:id"), F.col("id").cast("string"))
        return out.select("id", name.alias("cpe_name"), "deprecated", "part", "vendor", "product", "version")

    def components(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"))
        names = self.names()
        joined = lines.join(names, F.col("pk") == names["id"]).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("sbom_document_id"),
            F.concat(F.lit("pkg-"), F.col("l_linenumber").cast("string")).alias("bom_ref"),
            F.col("product").alias("name"),
            "version", "cpe_name", "part", "vendor", "product",
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("pk")) % 9).alias("k"),
            (F.col("l_orderkey") % 4).alias("b"),
        )

        def name(row, *parts):
            return F.concat(F.lit("cpe:2.3:"), *[row[p[1:]] if p[0] == "$" else F.lit(p) for p in parts])

        def cpe(row):
            head = ("$part", ":", "$vendor", ":", "$product")
            broken = (
                F.when(row["b"] == 0, F.concat(F.lit("cpe:/a:"), row["vendor"]))
                .when(row["b"] == 1, name(row, *head))
                .when(row["b"] == 2, name(row, "x:", "$vendor", ":", "$product", ":1:*:*:*:*:*:*:*"))
                .otherwise(name(row, *head, ":1:*:*:*:*:*:*:*\\"))
            )
            return (
                F.when(row["k"] == 0, "")
                .when(row["k"].isin(1, 2), row["cpe_name"])
                .when(row["k"] == 3, name(row, *head, ":", "$version", ":u1:*:*:*:*:*:*"))
                .when(row["k"] == 4, name(row, *head, ":99.9:*:*:*:*:*:*:*"))
                .when(row["k"] == 5, name(row, "$part", ":syft:", "$product", ":", "$version", ":*:*:*:*:*:*:*"))
                .when(row["k"] == 6, name(row, "$part", ":", "$vendor", ":lib", "$product", ":*:*:*:*:*:*:*:*"))
                .when(row["k"] == 7, broken)
                .otherwise(name(row, *head, ":-:*:*:*:*:*:*:*"))
            )

        cpe = bind(F.struct("part", "vendor", "product", "version", "cpe_name", "k", "b"), cpe)
        return joined.select("id", "sbom_document_id", "bom_ref", "name", "version", cpe.alias("cpe"))

    def located(self) -> DataFrame:
        """Components with their sbom and, where there is one, their image."""
        sboms = self.sboms().select(F.col("id").alias("sbom_document_id"), "docker_image_id", "source_path")
        images = self.images().select(F.col("id").alias("docker_image_id"), "repository", "tag")
        return self.components().join(sboms, "sbom_document_id").join(F.broadcast(images), "docker_image_id", "left")

    def reviews(self) -> DataFrame:
        """Ground truth on documents: quality and toxicity stand for the kind of decision."""
        return self.table("labels").select(
            F.col("doc_id").alias("component_id"),
            F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.concat(F.lit("cpe-"), F.col("doc_id").cast("string"))).alias("ground_truth_cpe"),
            F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.concat(F.lit("manual-"), F.col("doc_id").cast("string"))).otherwise("").alias("manual_ground_truth_cpe"),
            F.concat(F.lit("cpe-"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string")).alias("original_cpe"),
        )


#: The same views for DuckDB.
DOMAIN_SQL = r"""
images as (select cast(n_nationkey as bigint) id, concat('docker.io/library/',lower(n_name)) repository, lower(r_name) tag, 'linux/amd64' platform from nation join region on n_regionkey=r_regionkey),
sboms as (select o_orderkey id, case when o_orderstatus='P' then null else cast(c_nationkey % 23 as bigint) end docker_image_id, concat('sboms/',cast(o_orderkey as varchar),'.cdx.json') source_path, o_orderdate imported_at from orders join customer on o_custkey=c_custkey),
cpe_names as (select p_partkey id, concat(pre,':',v,':',p,':',ver,':*:*:*:*:*:*:id',cast(p_partkey as varchar)) cpe_name, p_partkey%10=0 deprecated, part, v vendor, p product, ver as version
 from (select p_partkey, case when p_size%10=0 then 'o' when p_size%10=1 then 'h' else 'a' end part, concat('cpe:2.3:',case when p_size%10=0 then 'o' when p_size%10=1 then 'h' else 'a' end) pre, replace(lower(p_brand),'#',concat(chr(92),'#')) v, replace(p_name,' ','_') p, concat(cast(p_size as varchar),'.',cast(p_partkey%3 as varchar)) ver from part) t),
components as (select id, sbom_document_id, bom_ref, name, version, case k when 0 then '' when 1 then cpe_name when 2 then cpe_name
  when 3 then concat('cpe:2.3:',part,':',vendor,':',product,':',version,':u1:*:*:*:*:*:*')
  when 4 then concat('cpe:2.3:',part,':',vendor,':',product,':99.9:*:*:*:*:*:*:*')
  when 5 then concat('cpe:2.3:',part,':syft:',product,':',version,':*:*:*:*:*:*:*')
  when 6 then concat('cpe:2.3:',part,':',vendor,':lib',product,':*:*:*:*:*:*:*:*')
  when 7 then case b when 0 then concat('cpe:/a:',vendor) when 1 then concat('cpe:2.3:',part,':',vendor,':',product) when 2 then concat('cpe:2.3:x:',vendor,':',product,':1:*:*:*:*:*:*:*') else concat('cpe:2.3:',part,':',vendor,':',product,':1:*:*:*:*:*:*:*',chr(92)) end
  else concat('cpe:2.3:',part,':',vendor,':',product,':-:*:*:*:*:*:*:*') end cpe
 from (select l_orderkey*10+l_linenumber id, l_orderkey sbom_document_id, concat('pkg-',cast(l_linenumber as varchar)) bom_ref, product as name, version, cpe_name, part, vendor, product, (l_orderkey*7+l_linenumber+pk)%9 k, l_orderkey%4 b
 from (select l_orderkey,l_linenumber,min(l_partkey) pk from lineitem group by l_orderkey,l_linenumber) g join cpe_names on cpe_names.id=pk) t),
located as (select c.*, s.docker_image_id, s.source_path, i.repository, i.tag from components c join sboms s on s.id = c.sbom_document_id left join images i on i.id = s.docker_image_id),
pieces as (select cpe, cpe like 'cpe:2.3:%' and regexp_full_match(substr(cpe,9),'(?:[^\\]|\\.)*','s') whole from (select distinct cpe from components) d),
cut as (select cpe, whole, case when whole then regexp_extract_all(concat(substr(cpe,9),':'), '((?:[^\\:]|\\.)*):', 1, 's') end f from pieces),
parsed as (select cpe, f, case when cpe not like 'cpe:2.3:%' then 'INVALID_PREFIX' when not whole then 'INVALID_ESCAPE' when len(f) <> 11 then 'INVALID_FIELD_COUNT' when f[1] not in ('a','o','h') then 'INVALID_PART' else 'STRUCTURALLY_VALID' end status from cut),
attrs as (select cpe, status, f, case when status='STRUCTURALLY_VALID' then f[1] else '' end part, case when status='STRUCTURALLY_VALID' then f[2] else '' end vendor, case when status='STRUCTURALLY_VALID' then f[3] else '' end product, case when status='STRUCTURALLY_VALID' then f[4] else '' end as version from parsed),
matched as (select p.cpe, p.status, case when p.cpe = '' then 'NOT_PRESENT' when n.cpe_name is null then 'NOT_IN_DICTIONARY' when n.deprecated then 'OFFICIAL_DEPRECATED' else 'OFFICIAL_ACTIVE' end match_status, n.id name_id, n.deprecated from parsed p left join cpe_names n on n.cpe_name = p.cpe),
usage as (select cpe, count(*) component_count from components where cpe <> '' group by cpe),
grouped as (select part, vendor, product, version, count(*) total, count(*) filter (not deprecated) active, count(*) filter (deprecated) deprecated_n from cpe_names group by all),
three as (select part, vendor, product, sum(total)::bigint total, sum(active)::bigint active, sum(deprecated_n)::bigint deprecated_n from grouped group by all),
two as (select part, product, sum(total)::bigint total, sum(active)::bigint active, sum(deprecated_n)::bigint deprecated_n from grouped group by all),
mismatch as (select a.cpe, a.status, a.part, a.vendor, a.product, a.version, u.component_count,
  coalesce(g.total,0) four_total, coalesce(g.active,0) four_active, coalesce(g.deprecated_n,0) four_deprecated, coalesce(t.total,0) three_total, coalesce(t.active,0) three_active, coalesce(t.deprecated_n,0) three_deprecated, coalesce(w.total,0) two_total, coalesce(w.active,0) two_active, coalesce(w.deprecated_n,0) two_deprecated,
  case when a.status <> 'STRUCTURALLY_VALID' then 'UNPARSABLE' when g.total > 0 then 'SAME_PART_VENDOR_PRODUCT_VERSION' when t.total > 0 then 'SAME_PART_VENDOR_PRODUCT' when w.total > 0 then 'SAME_PART_PRODUCT' else 'NO_STRUCTURED_MATCH' end profile
  from attrs a join usage u using (cpe) join matched m on m.cpe = a.cpe and m.match_status = 'NOT_IN_DICTIONARY'
  left join grouped g on a.status='STRUCTURALLY_VALID' and g.part=a.part and g.vendor=a.vendor and g.product=a.product and g.version=a.version
  left join three t on a.status='STRUCTURALLY_VALID' and t.part=a.part and t.vendor=a.vendor and t.product=a.product
  left join two w on a.status='STRUCTURALLY_VALID' and w.part=a.part and w.product=a.product),
reviews as (select doc_id component_id, case when quality=1 and toxic=0 then 'cpe-' || doc_id end ground_truth_cpe, case when quality=1 and toxic=1 then 'manual-' || doc_id else '' end manual_ground_truth_cpe, 'cpe-' || (case when doc_id % 2 = 0 then doc_id else doc_id + 1 end) original_cpe from labels),
outcomes as (select *, case when ground_truth_cpe = original_cpe then 'ORIGINAL_OFFICIAL_CONFIRMED' when ground_truth_cpe is not null then 'CORRECTED_TO_DICTIONARY' when manual_ground_truth_cpe <> '' then 'MANUAL_FROM_OFFICIAL_FAMILY' else 'DIRECT_OFFICIAL_NOT_CONFIRMED' end outcome from reviews)
"""


def over_domain(select: str) -> str:
    """A DuckDB statement that may use the views of the domain."""
    return f"with {DOMAIN_SQL}\n{select}"
