"""Column expressions: wikitext parsing and the rendering of pages and routes."""

from .text import page_string, quote, record_size, route_string, title_bytes
from .wikitext import capitalize, is_redirect, link_titles, redirect_target

__all__ = ["capitalize", "is_redirect", "link_titles", "page_string", "quote", "record_size", "redirect_target", "route_string", "title_bytes"]
