"""Enumerations, source ranks, the product document's schema and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of sources (the higher wins), and what each is trusted with.
SOURCE_RANK = {
    "unavailable": 0,
    "heuristic": 10,
    "opengraph": 25,
    "html": 30,
    "microdata": 35,
    "jsonld": 55,
    "embedded-json": 60,
    "woo-variation-form": 75,
    "woo-rest": 80,
    "platform-api": 80,
    "shopify-product-json": 85,
    "user": 100,
}
CONFIDENCE = {s: "none" if s == "unavailable" else "low" if s == "heuristic" else "medium" if s in ("html", "opengraph", "microdata") else "high" for s in SOURCE_RANK}
PLATFORMS = ("shopify", "woocommerce", "wordpress-generic", "bigcommerce", "magento", "squarespace", "unknown")
KINDS = ("simple", "variable", "grouped", "external", "unknown")
STOCK = ("in_stock", "out_of_stock", "on_backorder", "preorder", "unknown")
URL_STATES = ("pending", "processing", "completed", "warning", "failed", "retrying", "skipped", "paused")
JOB_STATES = ("queued", "running", "paused", "completed", "cancelled", "failed")
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
LOG_LEVELS = ("debug", "info", "warn", "error")
#: Fields that start as 'unknown' with no provenance: any first real offer replaces that.
UNKNOWN_FIELDS = ("kind", "stockStatus", "status", "sourcePlatform", "google.condition")


def lookup(values: dict[str, int | str], key: Column) -> Column:
    """The value of a small fixed dictionary, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def rank_of(source: Column) -> Column:
    return lookup(SOURCE_RANK, source)


def confidence_of(source: Column) -> Column:
    return lookup(CONFIDENCE, source)


def severity_rank(severity: Column) -> Column:
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, severity)


def severity_label(rank: Column) -> Column:
    label = F.when(rank == 0, SEVERITIES[0])
    for i, name in enumerate(SEVERITIES[1:], 1):
        label = label.when(rank == i, name)
    return label


MONEY = "decimal(18,6)"
OPTION = "struct<name:string,value:string>"
IMAGE = "struct<url:string,position:int,alt:string,title:string,width:int,height:int,is_featured:boolean,variant_ids:array<string>,source:string>"
OPTION_DEFINITION = "struct<name:string,values:array<string>,position:int>"
ATTRIBUTE = "struct<name:string,values:array<string>,is_global:boolean,is_variation:boolean,visible:boolean,position:int>"
VARIANT = (
    f"struct<id:string,parent_id:string,source_variant_id:string,position:int,options:array<{OPTION}>,sku:string,barcode:string,price:{MONEY},compare_at_price:{MONEY},regular_price:{MONEY},sale_price:{MONEY},cost_per_item:{MONEY},currency:string,"
    "stock_status:string,available:boolean,inventory_quantity:bigint,inventory_policy:string,inventory_tracker:string,backorders_allowed:boolean,weight:double,weight_unit:string,length:double,width:double,height:double,dimension_unit:string,"
    "requires_shipping:boolean,taxable:boolean,image_url:string,title:string>"
)
SEO = "struct<title:string,meta_description:string,description:string,og_title:string,og_description:string,og_image:string,canonical_url:string,robots:string,keywords:array<string>>"
GOOGLE = (
    "struct<google_product_category:string,gender:string,age_group:string,mpn:string,gtin:string,brand:string,condition:string,identifier_exists:boolean,color:string,size:string,size_system:string,material:string,pattern:string,item_group_id:string,"
    "product_type:string,ads_grouping:string,ads_labels:array<string>,custom_label_0:string,custom_label_1:string,custom_label_2:string,custom_label_3:string,custom_label_4:string,multipack:int,is_bundle:boolean,shipping_weight:string>"
)
PROVENANCE = "map<string,struct<source:string,confidence:string,note:string,conflict:struct<other_source:string,other_value:string>>>"
#: One row for each product.
PRODUCT = (
    f"id string, ordinal long, project_id string, category_id string, category_path string, source_url string, source_product_id string, source_platform string, handle string, kind string, source_product_type string, title string, vendor string, brand string, "
    f"description_html string, description_text string, short_description_html string, short_description_text string, purchase_note string, tags array<string>, status string, published boolean, price {MONEY}, regular_price {MONEY}, sale_price {MONEY}, "
    f"compare_at_price {MONEY}, cost_per_item {MONEY}, price_min {MONEY}, price_max {MONEY}, currency string, sku string, barcode string, stock_status string, inventory_quantity bigint, low_stock_amount bigint, inventory_policy string, "
    f"backorders_allowed boolean, sold_individually boolean, weight double, weight_unit string, length double, width double, height double, dimension_unit string, requires_shipping boolean, taxable boolean, tax_status string, tax_class string, shipping_class string, "
    f"options array<{OPTION_DEFINITION}>, attributes array<{ATTRIBUTE}>, variants array<{VARIANT}>, images array<{IMAGE}>, featured_image_url string, seo {SEO}, google {GOOGLE}, rating_value double, review_count bigint, allow_reviews boolean, external_url string, "
    f"external_button_text string, provenance {PROVENANCE}, extraction_notes array<string>, layers_used array<string>, scraped_at timestamp, content_hash string"
)


def field_names(kind: str) -> list[str]:
    """Names of the fields of a struct type's text, without those of what is nested in it."""
    depth, top = 0, []
    for c in kind[len("struct<") : -1]:
        depth -= c == ">"
        top.append(c if depth == 0 else "")
        depth += c == "<"
    return [part.split(":", 1)[0].strip() for part in "".join(top).split(",") if ":" in part]


def struct_of(kind: str, known: dict[str, Column]) -> Column:
    """A struct of that type with the known fields; the others are null."""
    return F.struct(*[known.get(n, F.lit(None)).alias(n) for n in field_names(kind)]).cast(kind)


def columns_of(ddl: str) -> dict[str, str]:
    """Column names and types of a schema's text."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(ddl[last:i].strip())
            last = i + 1
    return dict(x.split(" ", 1) for x in (*parts, ddl[last:].strip()))


@dataclass(frozen=True)
class ExportOptions:
    """Parameters of an export."""

    profile: str = "shopify-legacy"
    category_ids: tuple[str, ...] = ()
    product_ids: tuple[str, ...] = ()
    exclude_errors: bool = True
    exclude_warnings: bool = False
    generate_parent_keys: bool = True
    key_prefix: str = "P-"


@dataclass(frozen=True)
class Settings:
    """Defaults of a collection run."""

    request_delay_ms: int = 1200
    concurrency: int = 3
    per_host_concurrency: int = 1
    request_timeout_ms: int = 30_000
    render_timeout_ms: int = 45_000
    max_retries: int = 2
    retry_base_ms: int = 4000
    retry_after_most_ms: int = 60_000
    most_variations: int = 250
    most_combinations: int = 60
    most_gallery_images: int = 30
    log_rows: int = 3000
