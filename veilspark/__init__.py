"""veilspark: audits large document collections for text that a reader cannot see."""

from importlib import import_module

__version__ = "0.2.0"

_EXPORTS = {
    "Config": "config",
    "analyzed": "operators.spans",
    "detail_report": "operators.reports",
    "gate_report": "operators.reports",
    "load": "sources.files",
    "risk_report": "operators.risk",
    "sanitize": "operators.sanitize",
    "spans_of_files": "sources.files",
    "web_report": "operators.reports",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    # loaded when asked for: Python workers import this package for every task
    if name in _EXPORTS:
        found = getattr(import_module(f"{__name__}.{_EXPORTS[name]}"), name)
        globals()[name] = found  # a module of this name may stand here by now
        return found
    raise AttributeError(name)
