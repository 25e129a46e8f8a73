"""Schemas of the stored tables and of the records that pass between operators.

Times are ``timestamp_ntz`` in UTC.  Parquet enforces no keys; the operators
that write a table keep the keys named here unique.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

SITES = "id bigint, slug string, base_url string, course_index_url string"  # key id; slug
PAGES = (
    "id bigint, site_id bigint, url string, slug string, title string, last_crawled_at timestamp_ntz, modified_gmt string,"
    " kind string, sort_order int, internal_links_synced_at timestamp_ntz"
)  # key id; (site_id, url)
LINKS = (
    "id bigint, url string, host string, first_seen_at timestamp_ntz, last_checked_at timestamp_ntz, next_check_at timestamp_ntz,"
    " last_http_status int, last_error_type string, consecutive_failures int, status string"
)  # key id; url
PAGE_LINKS = (
    "id bigint, page_id bigint, link_id bigint, day_context string, day_label string, link_text string, context_before string,"
    " context_after string, last_seen_at timestamp_ntz"
)  # key id; (page_id, link_id, day_context)
PAGE_INTERNAL_LINKS = "page_id bigint, child_url string"  # key both
LINK_CHECKS = (
    "id bigint, link_id bigint, checked_at timestamp_ntz, http_status int, error_type string, response_time_ms int, classified_broken int"
)  # key id; append only
DOMAIN_STATE = "host string, last_request_started_at timestamp_ntz"  # key host
DOMAIN_CLAIMS = "id bigint, link_id bigint, host string, claimed_at timestamp_ntz"  # key id

TABLES: dict[str, str] = {
    "sites": SITES,
    "pages": PAGES,
    "links": LINKS,
    "page_links": PAGE_LINKS,
    "page_internal_links": PAGE_INTERNAL_LINKS,
    "link_checks": LINK_CHECKS,
    "domain_state": DOMAIN_STATE,
    "domain_claims": DOMAIN_CLAIMS,
}

#: An external link found on a page.
EXTRACTED = "ord int, url string, text string, day_context string, context_before string, context_after string, day_label string"


def struct(ddl: str) -> StructType:
    """The schema of a table given as DDL."""
    return StructType.fromDDL(ddl)
