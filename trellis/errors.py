"""What a query can be refused for."""


class QueryError(ValueError):
    """Any refusal."""


class SyntaxProblem(QueryError):
    """The text isn't a query."""


class SemanticProblem(QueryError):
    """The query is well formed but has no meaning."""


class Unsupported(QueryError):
    """A clause or form that the language subset leaves out."""
