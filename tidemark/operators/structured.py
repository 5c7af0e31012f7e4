"""Structured data (N03-N05, A13, J07, K21, K22): expected fields of types, gaps, summaries, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a type should have; another table is a parameter of the functions below.
EXPECTED = {
    "Organization": ["name", "url"],
    "LocalBusiness": ["name", "address", "telephone"],
    "Service": ["name", "provider"],
    "Product": ["name", "image", "offers"],
    "Offer": ["price", "priceCurrency", "availability"],
    "Article": ["headline", "author", "datePublished", "image"],
    "NewsArticle": ["headline", "author", "datePublished", "image"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "BreadcrumbList": ["itemListElement"],
    "Event": ["name", "startDate", "location"],
    "JobPosting": ["title", "description", "datePosted", "hiringOrganization"],
    "Course": ["name", "description", "provider"],
    "Recipe": ["name", "image", "recipeIngredient"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
    "SoftwareApplication": ["name", "operatingSystem"],
    "Person": ["name"],
    "ProfilePage": ["mainEntity"],
    "Dataset": ["name", "description"],
    "WebSite": ["name", "url"],
    "WebPage": ["name", "url"],
    "FAQPage": ["mainEntity"],
    "HowTo": ["name", "step"],
    "LodgingBusiness": ["name", "address"],
    "Hotel": ["name", "address"],
    "Resort": ["name", "address"],
    "VacationRental": ["name", "address"],
    "EducationalOrganization": ["name", "url"],
    "School": ["name", "url"],
    "CollegeOrUniversity": ["name", "url"],
    "ProfessionalService": ["name", "address"],
    "MedicalOrganization": ["name", "address"],
    "Restaurant": ["name", "address"],
    "Store": ["name", "address"],
    "RealEstateAgent": ["name", "address"],
    "TravelAgency": ["name", "address"],
}
#: Types whose template has a postal address.
ADDRESSED = [
    "Organization", "LocalBusiness", "LodgingBusiness", "Hotel", "Resort", "VacationRental", "EducationalOrganization", "School", "CollegeOrUniversity",
    "ProfessionalService", "MedicalOrganization", "Restaurant", "Store", "RealEstateAgent", "TravelAgency",
]


def field_gaps(objects: DataFrame, expected: dict[str, list[str]] | None = None) -> DataFrame:
    """Objects (page_url, type, body: JSON text) with the expected fields that are missing or empty.
    The dictionary becomes a CASE, so nothing is joined; a type that is not in it has no gaps."""
    known = expected or EXPECTED
    fields: Column = F.array().cast("array<string>")
    for kind, names in known.items():
        fields = F.when(F.col("type") == kind, F.array(*map(F.lit, names))).otherwise(fields)
    body = F.from_json("body", "map<string,string>")
    return objects.select("*", F.filter(fields, lambda f: F.coalesce(F.get(F.map_values(F.map_filter(body, lambda k, v: k == f)), F.lit(0)), F.lit("")) == "").alias("missing"))


def finding_status(valid: Column, missing: Column) -> Column:
    """K21."""
    return F.when(~valid, "fail").when(F.size(missing) > 0, "warn").otherwise("pass")


def page_status(n_invalid: Column, n_types: Column) -> Column:
    """K22."""
    return F.when(n_invalid > 0, "invalid").when(n_types > 0, "found").otherwise("missing")


def summary(pages: DataFrame) -> DataFrame:
    """Pages (valid_blocks, invalid_blocks, types) in one row."""
    has = F.size("types") > 0
    kinds = pages.select(F.explode("types").alias("t")).distinct().agg(F.sort_array(F.collect_list("t")).alias("types"))
    one = pages.agg(
        F.count("*").alias("pages"), F.count_if(has).alias("with_types"), F.count_if(~has).alias("without_types"), F.coalesce(F.sum("valid_blocks"), F.lit(0)).cast("long").alias("valid_blocks"),
        F.coalesce(F.sum("invalid_blocks"), F.lit(0)).cast("long").alias("invalid_blocks"),
    )
    return one.crossJoin(F.broadcast(kinds))


def recommendations(pages: DataFrame, recs: DataFrame, order: str = "ord") -> DataFrame:
    """Each page's own recommendation (the last one given), else the first of all, else WebPage."""
    own = recs.where("url is not null").groupBy("url").agg(F.max_by("type", order).alias("own"))
    general = recs.agg(F.min_by("type", order).alias("general"))
    out = pages.join(own, "url", "left").crossJoin(F.broadcast(general))
    return out.select(*pages.columns, F.coalesce("own", "general", F.lit("WebPage")).alias("recommended"))


#: What templates say where nothing is known.
UNNAMED, PUBLISHER, PAGE, IN_STOCK = "Organization", "Publisher", "Page", "https://schema.org/InStock"
FIELDS = "map<string,string>"


def template(kind: Column, name: Column, url: Column, description: Column, site_name: Column | None = None, image: Column | None = None, fields: Column | None = None, pretty: bool = True) -> Column:
    """A JSON-LD text for a type; what is not known is empty.  fields: a map of texts that go before what the page says."""
    given = F.create_map().cast(FIELDS) if fields is None else F.coalesce(fields, F.create_map().cast(FIELDS))
    own = lambda n: F.try_element_at(given, F.lit(n))
    known = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    nothing = F.lit("")
    site, picture = (nothing if c is None else c for c in (site_name, image))
    typed = lambda t, *parts: F.struct((F.lit(t) if isinstance(t, str) else t).alias("@type"), *parts)
    said = lambda *names: [known(own(n)).alias(n) for n in names]
    head = [F.lit("https://schema.org").alias("@context"), kind.alias("@type")]
    rest = [known(own("url"), url).alias("url"), known(own("description"), description).alias("description")]
    base = [*head, known(own("name"), name, F.lit(PAGE)).alias("name"), *rest]
    home = F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1)
    brand = F.when(known(own("brand")) != "", typed("Brand", own("brand").alias("name"))).alias("brand")
    search = F.when(known(own("searchTarget")) != "", typed("SearchAction", F.concat(own("searchTarget"), F.lit("{search_term_string}")).alias("target"), F.lit("required name=search_term_string").alias("query-input"))).alias("potentialAction")
    texts = {
        "addressed": [*head, known(own("name"), site, F.lit(UNNAMED)).alias("name"), *rest, known(own("logo"), picture).alias("logo"), *said("email", "telephone"), typed("PostalAddress", *said("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")).alias("address")],
        "service": [*base, known(own("serviceType"), name).alias("serviceType"), *said("areaServed"), typed("Organization", known(own("providerName"), site, F.lit(UNNAMED)).alias("name"), known(own("providerUrl"), home).alias("url")).alias("provider")],
        "article": [*base, known(own("headline"), name).alias("headline"), typed(known(own("authorType"), F.lit("Organization")), known(own("authorName"), site, F.lit(PUBLISHER)).alias("name")).alias("author"), *said("datePublished", "dateModified"), known(own("image"), picture).alias("image")],
        "product": [*base, known(own("image"), picture).alias("image"), *said("sku"), brand, typed("Offer", *said("priceCurrency", "price"), known(own("availability"), F.lit(IN_STOCK)).alias("availability"), known(own("url"), url).alias("url")).alias("offers")],
        "crumbs": [*head, F.array(*[typed("ListItem", F.lit(k).alias("position"), n.alias("name"), u.alias("item")) for k, n, u in ((1, F.lit("Home"), home), (2, known(name), known(url)))]).alias("itemListElement")],
        "site": [*base, search],
        "other": base,
    }
    options = {"pretty": "true"} if pretty else {}
    made = {k: F.to_json(F.struct(*v), options) for k, v in texts.items()}
    out = F.when(kind.isin(ADDRESSED), made["addressed"]).when(kind == "Service", made["service"]).when(kind.isin("Article", "BlogPosting", "NewsArticle"), made["article"])
    return out.when(kind == "Product", made["product"]).when(kind == "BreadcrumbList", made["crumbs"]).when(kind == "WebSite", made["site"]).otherwise(made["other"])


def chosen_type(requested: Column, supported: list[str], preferred: str | None) -> Column:
    """The requested type if it is supported, else the preferred, else the first."""
    return F.when(requested.isin(supported), requested).otherwise(F.lit(preferred if preferred in supported else supported[0]))
