

from . import boards, files, keyed, more, queries  # noqa: F401  all register their queries
