"""Schemas of the stored tables and of what passes between operators."""

from __future__ import annotations

WEBSITES = "id long, created timestamp_ntz, modified timestamp_ntz, crawl_depth int, url string"
WEBPAGES = (
    "id long, website_id long, url string, crawl_created timestamp_ntz, crawl_modified timestamp_ntz, content string, revisit string, "
    "published_time timestamp_ntz, modified_time timestamp_ntz, expiration_time timestamp_ntz, title string, description string, "
    "author string, section string, tag string, keywords string, page long"
)
PARAGRAPHS = "id long, webpage_id long, headings_id long, paragraph string not null"
HEADINGS = "id long, webpage_id long, h1 string, h2 string, h3 string, h4 string, h5 string, h6 string"
TABLES = {"websites": WEBSITES, "webpages": WEBPAGES, "paragraphs": PARAGRAPHS, "headings": HEADINGS}

NODE = "struct<pos:int,tag:string,attrs:map<string,string>,own:string,text:string,path:string>"
ROBOTS = "struct<delay:double,sitemaps:array<string>,entries:array<struct<agents:array<string>,rules:array<struct<path:string,allow:boolean>>>>,default_rules:array<struct<path:string,allow:boolean>>,complete:boolean>"
SITEMAP = "struct<kind:string,records:array<struct<links:string,modified_time:string,revisit:string>>>"
FRONTIER = "base string, depth int, url string, seq long"
