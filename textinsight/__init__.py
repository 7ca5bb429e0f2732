"""Survey and web site insight on Spark."""

from .operators.completion import complete
from .operators.crawl import crawl_frontier, html_links, link_table
from .operators.grouping import distinct_clusters, filter_cluster, group_responses
from .operators.keywords import cluster_keywords, site_keywords
from .operators.kmeans import kmeans_cluster, lloyd_kmeans
from .operators.report import build_report, write_report, write_site_report
from .operators.sentiment import apply_text_fn, polarity, sentiment_label, with_sentiment
from .operators.site import page_fields, site_profile
from .operators.tfidf import tfidf, tfidf_by_group
from .plans.sites import compare_sites, profile_sites, summarize_sites
from .plans.survey import analyze_survey, summarize_clusters
from .session import build_session

__all__ = [
    "analyze_survey", "apply_text_fn", "build_report", "build_session", "cluster_keywords", "compare_sites",
    "complete", "crawl_frontier", "distinct_clusters", "filter_cluster", "group_responses", "html_links",
    "kmeans_cluster", "link_table", "lloyd_kmeans", "page_fields", "polarity", "profile_sites",
    "sentiment_label", "site_keywords", "site_profile", "summarize_clusters", "summarize_sites", "tfidf",
    "tfidf_by_group", "with_sentiment", "write_report", "write_site_report",
]
