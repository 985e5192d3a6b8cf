"""Explicit schemas of the tables that operators exchange."""

PAPERS = (
    "paper_id string, doi string, title string, abstract string, year int, venue string, "
    "authors array<struct<name: string, affiliations: array<string>, country_codes: array<string>>>, "
    "url string, source string, sources array<string>, time_window string, primary_topic string, primary_subfield string"
)
DOCUMENTS = (
    "doc_id string, title string, abstract string, year int, venue string, doi string, url string, source string, primary_topic string, "
    "primary_subfield string, authors array<string>, home_affiliations array<string>, n_authors int, time_window string, text string"
)
TOKENS = "doc_id string, year int, time_window string, tokens array<string>"
TOPICS = "model string, topic_id int, rank int, term string, weight double"
RATINGS = "rater string, item string, rating int"
MEMBERSHIPS = "variable string, name string, a double, b double, c double, d double"
RULES = "rule_id int, antecedents map<string, string>, out_variable string, out_set string, weight double"
RUNS = "function string, dim int, algorithm string, run int, value double"
