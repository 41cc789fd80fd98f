"""Every registered query outside the llm subpackage."""

from . import checks, decisions, domain, journal, live, rules, runs, scale, views  # noqa: F401
from .base import REGISTRY  # noqa: F401
