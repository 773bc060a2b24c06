"""skein: a Spark-native engine for code-index analytics and training-data preparation.

Every operator takes and returns DataFrames.  Nothing here starts a session,
collects an unbounded result or assumes local mode.
"""

__version__ = "0.1.0"

_EXPORTED = {"CodeIndex": "skein.api", "tools": "skein.api", "AssistantServer": "skein.server", "register_language": "skein.sources.parse", "register_exporter": "skein.render.text"}
__all__ = ["__version__", *_EXPORTED]


def __getattr__(name: str):
    if name in _EXPORTED:
        from importlib import import_module

        return getattr(import_module(_EXPORTED[name]), name)
    raise AttributeError(name)
