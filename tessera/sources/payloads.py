"""Rows from pages and JSON payloads: search results, profiles, publication details, robots rules."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Field labels of detail pages, rows of the metrics table, signs of a block.
BLOCK_SIGNS = ("unusual traffic", "not a robot", "gs_captcha", "recaptcha", "/sorry/", "system can't perform the operation now", "system can&#39;t perform the operation now")
LABELS = {"authors": "auteurs", "publication date": "date_publication_raw", "journal": "journal", "conference": "conference", "volume": "volume", "issue": "numero", "pages": "pages", "publisher": "publisher", "description": "abstract", "book": "venue_other", "source": "venue_other"}
METRIC_ROWS = {"citations": "citations", "h-index": "h_index", "i10-index": "i10_index"}
SITE = "https://scholar.google.com"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Elements in document order; of each the attributes, and where its descendants and its text end."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.after, self.text = [], [], [], []
        self.begin, self.end, self.depth, self.open = [], [], [], []
        self.feed(page)
        self.close()
        self._leave(0)

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.depth.append(len(self.open))
        self.begin.append(len(self.text))
        self.end.append(len(self.text))
        self.after.append(len(self.tags))
        if tag not in _VOID:
            self.open.append(len(self.tags) - 1)

    def _leave(self, to: int) -> None:
        for node in self.open[to:]:
            self.after[node], self.end[node] = len(self.tags), len(self.text)
        del self.open[to:]

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[k]] == tag:
                return self._leave(k)

    def handle_data(self, data):
        if data.strip():
            self.text.append(data.strip())

    def find(self, what: str, inside: int | None = None):
        """Elements like tag.class or #id, all or below one."""
        tag, mark, name = what.replace("#", ".#").partition(".")
        low, high = (0, len(self.tags)) if inside is None else (inside + 1, self.after[inside])
        for k in range(low, high):
            if tag and self.tags[k] != tag:
                continue
            if not mark or (self.attrs[k].get("id") == name[1:] if name.startswith("#") else name in self.attrs[k].get("class", "").split()):
                yield k

    def first(self, what: str, inside: int | None = None) -> int | None:
        return next(self.find(what, inside), None)

    def said(self, node: int | None) -> str | None:
        """An element's text, its pieces joined by spaces; none is null."""
        return None if node is None else " ".join(self.text[self.begin[node] : self.end[node]]) or None

    def texts(self, what: str, inside: int | None = None) -> list[str]:
        return [t for k in self.find(what, inside) if (t := self.said(k))]


def _number(text: str | None) -> int | None:
    digits = re.sub(r"\D", "", text or "")
    return int(digits) if digits else None


def _parameter(address: str, name: str) -> str | None:
    return (parse_qs(urlsplit(address).query).get(name) or [None])[0]


def _domain(text: str | None) -> str | None:
    found = re.search(r"Verified email at\s+([\w.\-]+)", text or "", re.I)
    return found.group(1).lower() if found else None


def _hits(t: _Tree) -> list[dict]:
    out = []
    for block in t.find("div.gsc_1usr"):
        link = next((a for h in t.find("h3.gs_ai_name", block) for a in t.find("a", h)), None)
        external = _parameter(t.attrs[link].get("href", ""), "user") if link is not None else None
        if external:
            one = lambda cls: t.said(t.first(f"div.{cls}", block))  # noqa: B023, E731
            out.append({"external_id": external, "name": t.said(link), "affiliation": one("gs_ai_aff"), "email_domain": _domain(one("gs_ai_eml")), "interests": t.texts("a.gs_ai_one_int", block), "cited_by": _number(one("gs_ai_cby")), "url": f"{SITE}/citations?user={external}&hl=en"})
    return out


def _metrics(t: _Tree) -> tuple[dict, int | None]:
    """Counts of all time and since a year, and that year."""
    table = t.first("#gsc_rsb_st")
    out, since = {}, None
    if table is not None:
        year = re.search(r"Since\s+(\d{4})", t.said(t.first("thead", table)) or "")
        since = int(year.group(1)) if year else None
        for body in t.find("tbody", table):
            for row in t.find("tr", body):
                name = METRIC_ROWS.get((t.said(t.first("td.gsc_rsb_sc1", row)) or "").lower())
                values = [_number(t.said(k)) for k in t.find("td.gsc_rsb_std", row)]
                if name and values:
                    out |= {name: values[0], f"{name}_since": values[1] if len(values) > 1 else None}
    return out, since


def _listed(t: _Tree) -> list[dict]:
    """Rows of the list of publications.  An empty count is 0, a star unknown."""
    out = []
    for row in t.find("tr.gsc_a_tr"):
        link = t.first("a.gsc_a_at", row)
        if link is None:
            continue
        address = t.attrs[link].get("href", "")
        gray = [t.said(k) for k in t.find("div.gs_gray", row)]
        year = next((s for cell in t.find("td.gsc_a_y", row) for s in t.find("span", cell)), None)
        cited = t.said(t.first("td.gsc_a_c", row))
        out.append({"scholar_pub_id": _parameter(address, "citation_for_view"), "titre": t.said(link), "auteurs_listing": gray[0] if gray else None, "venue_raw": gray[1] if len(gray) > 1 else None, "annee": _number(t.said(year)), "citations": None if cited == "*" else _number(cited) or 0, "scholar_url": urljoin(SITE, address) if address else None})
    return out


def _links(t: _Tree, where: str) -> list[tuple[str, str]]:
    """Address and text of the links that say something, below an element."""
    box = t.first(where)
    found = [] if box is None else [(t.attrs[a].get("href", ""), t.said(a)) for a in t.find("a", box)]
    return [(address, text) for address, text in found if text]


def _profile(t: _Tree) -> dict:
    name = t.said(t.first("#gsc_prf_in"))
    if name is None:
        return {"error": "no profile name"}
    box = t.first("#gsc_prf_i")
    lines = [] if box is None else [t.said(k) for k in t.find(".gsc_prf_il", box)]
    place = lines[0] if lines and not (lines[0] or "").lower().startswith("verified email") else None
    metrics, since = _metrics(t)
    more = t.first("#gsc_bpf_more")
    return {"name": name, "affiliation": place, "email_domain": _domain(t.said(t.first("#gsc_prf_ivh"))), "interests": [x for _, x in _links(t, "#gsc_prf_int")], "metrics": metrics, "since_year": since, "coauthors": [x for a, x in _links(t, "#gsc_rsb_co") if "user=" in a], "publications": _listed(t), "has_more": more is not None and "disabled" not in t.attrs[more]}


def _detail(t: _Tree) -> dict:
    title = t.first("#gsc_oci_title")
    if title is None:
        return {"error": "no title"}
    own = next(t.find("a.gsc_oci_title_link"), None)
    own = t.first("a", title) if own is None else own
    papers = [a for where in ("#gsc_oci_title_gg", ".gsc_vcd_title_ggi") for box in t.find(where) for a in t.find("a", box)]
    out = {"titre": t.said(title), "external_url": None if own is None else t.attrs[own].get("href"), "pdf_url": t.attrs[papers[0]].get("href") if papers else None}
    for block in t.find(".gs_scl"):
        field = LABELS.get((t.said(t.first(".gsc_oci_field", block)) or "").lower())
        value = t.first(".gsc_oci_value", block)
        if field and value is not None and field not in out:
            told = " ".join(t.texts(".gsh_csp", value)) if field == "abstract" else ""
            told = told or t.said(value)
            if told:
                out[field] = told
    out["auteurs"] = [a.strip() for a in out.get("auteurs", "").split(",") if a.strip()]
    return out


def _parsed(read):
    """A function of pages as JSON text; a null page gives null, one that cannot be read its error."""

    @pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        def one(page):
            try:
                return json.dumps(read(_Tree(page)))
            except (ValueError, AssertionError) as fault:
                return json.dumps({"error": str(fault)})

        return pages.map(one, na_action="ignore")

    return run


_LISTED = "struct<scholar_pub_id:string,titre:string,auteurs_listing:string,venue_raw:string,annee:int,citations:int,scholar_url:string>"
_HIT = "struct<external_id:string,name:string,affiliation:string,email_domain:string,interests:array<string>,cited_by:int,url:string>"
_PROFILE = f"struct<name:string,affiliation:string,email_domain:string,interests:array<string>,metrics:map<string,int>,since_year:int,coauthors:array<string>,publications:array<{_LISTED}>,has_more:boolean,error:string>"
_DETAIL = "struct<titre:string,external_url:string,pdf_url:string,auteurs:array<string>,date_publication_raw:string,journal:string,conference:string,volume:string,numero:string,pages:string,publisher:string,abstract:string,venue_other:string,error:string>"
_read_hits, _read_profile, _read_detail = _parsed(_hits), _parsed(_profile), _parsed(_detail)
_read_tags = _parsed(lambda t: [{"tag": tag, "depth": depth} for tag, depth in zip(t.tags, t.depth, strict=True)])


def profile(html: Column) -> Column:
    """A profile page as a struct; error says why it is none."""
    return F.from_json(_read_profile(html), _PROFILE)


def publication_detail(html: Column) -> Column:
    """A publication's page as a struct, the first of a label counting; error says why it is none."""
    return F.from_json(_read_detail(html), _DETAIL)


def search_results(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' columns with external_id, name, affiliation, email_domain, interests, cited_by and url of every hit with
    an id, position first."""
    hits = pages.withColumn("_h", F.from_json(_read_hits(F.col(html)), f"array<{_HIT}>"))
    return hits.select(*pages.columns, F.posexplode("_h").alias("position", "_x")).select(*pages.columns, "position", "_x.*")


def html_nodes(html: Column) -> Column:
    """Elements of a page, tag and depth, in document order; a null page has none."""
    return F.from_json(_read_tags(html), "array<struct<tag:string,depth:int>>")


def robots(text: str, agent: str) -> list[tuple[str, bool]]:
    """(pattern, allow) of the groups of robots.txt that name the agent, else of those for all."""
    groups: dict[str, list] = {}
    names, fresh = [], True
    for line in text.splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*([] if fresh else names), value.lower()]
            groups.setdefault(value.lower(), [])
            fresh = False
        elif field in ("allow", "disallow"):
            fresh = True
            for name in names:
                groups[name].append((value, field == "allow"))
    named = [name for name in groups if name not in ("", "*") and name in agent.lower()]
    return [r for name in named for r in groups[name]] if named else groups.get("*", [])


def permitted(rules: list[tuple[str, bool]], path: str) -> bool:
    """robots_allowed() for one path."""
    fit = [(len(p), allow) for p, allow in rules if p and re.match(re.escape(p[:-1] if p.endswith("$") else p).replace(r"\*", ".*") + ("$" if p.endswith("$") else ""), path)]
    return max(fit, default=(0, True))[1]


def robots_rules(spark: SparkSession, text: str | None, agent: str) -> DataFrame:
    """robots() as a table.  Unreadable: nothing is allowed."""
    return spark.createDataFrame([("/", False)] if text is None else robots(text, agent), "pattern string, allow boolean")


def scholar_id(html: Column) -> Column:
    """The id most often found in publication links, the first seen of equals; null without any."""
    found = F.regexp_extract_all(html, F.lit(r"citation_for_view=([\w-]{12})"), F.lit(1))
    other = F.regexp_extract_all(html, F.lit(r"[?&;]user=([\w-]{12})"), F.lit(1))
    ids = F.when(F.size(found) > 0, found).otherwise(other)
    counted = F.transform(F.array_distinct(ids), lambda i, k: F.struct((-F.size(F.filter(ids, lambda x: x == i))).alias("n"), k.alias("k"), i.alias("id")))
    return F.array_min(counted)["id"]


def is_blocked(status: Column, url: Column, html: Column) -> Column:
    """Too many requests, a refusal, or a page that asks for proof of being human."""
    signs = F.lit(False)
    for sign in BLOCK_SIGNS:
        signs = signs | F.contains(F.lower(html), F.lit(sign))
    return F.coalesce(status.isin(429, 403), F.lit(False)) | F.coalesce(F.contains(url, F.lit("/sorry/")), F.lit(False)) | F.coalesce(signs, F.lit(False))


def page_status(html: Column, name: Column) -> Column:
    return F.when(is_blocked(F.lit(200), F.lit(""), html), "robot_check").when(name.isNull(), "not_a_profile").otherwise("ok")


def listing_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "...", "…"))


def robots_allowed(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """urls with allowed: the longest rule that matches, allow winning ties, none meaning allowed.

    rules has (pattern, allow); '*' stands for anything and a final '$' for the end.  A site's rules are few.
    """
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([.\\+?^{}()|\[\]])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.when(F.col("pattern").endswith("$"), quoted).otherwise(F.regexp_replace(quoted, r"\$", r"\\$")))
    listed = F.broadcast(rules.where(F.length("pattern") > 0).agg(F.collect_list(F.struct(F.length("pattern").alias("size"), F.col("allow").cast("int").alias("allow"), regex.alias("regex"))).alias("_rules")))
    fit = F.filter("_rules", lambda r: F.regexp_like(F.col(path), r["regex"]))
    return urls.join(listed).withColumn("allowed", F.coalesce(F.array_max(fit)["allow"] == 1, F.lit(True))).drop("_rules")
