"""The address rules of the registered query."""

from hiresift.llm import url_filter

Rule = url_filter.Rule
RULES = (
    Rule.host("allow", "org", "/"), Rule.host("block", "example.org", "/es/"),
    Rule.host("block", "example.org", "/en/1"), Rule.host("allow", "com", "/fr/"), Rule.host("block", "com", "/de/"),
) + url_filter.DEFAULT_PATTERNS
