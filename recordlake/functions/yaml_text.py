"""One YAML document to JSON text, for the blocks that the built-in rewriting leaves over."""

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle

try:
    import yaml
except ImportError:  # only needed for blocks beyond flat ``key: scalar`` lines
    yaml = None

# Executors get these functions with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The scalar forms of the YAML 1.2 core schema.
NULL_WORDS = r"~|null|Null|NULL"
TRUE_WORDS = r"true|True|TRUE"
FALSE_WORDS = r"false|False|FALSE"
JSON_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+"
OTHER_NUMBER = (
    r"0o[0-7]+|0x[0-9a-fA-F]+"
    r"|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"
    r"|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)"
)

def yaml_batch_to_json(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    return pa.array([None if t is None else yaml_text_to_json(t) for t in texts.to_pylist()], pa.string())


# Aliases may repeat at most this many nodes; beyond it, a document is invalid.  Nodes met for the first time never count.
_MAX_REPEATED = 1_000_000
_PLAIN_TAG = "plain"
_loader = None


def _loader_class():
    global _loader
    if _loader is None:
        if yaml is None:
            raise ImportError("PyYAML is needed for YAML beyond flat `key: scalar` lines")
        base = getattr(yaml, "CBaseLoader", yaml.BaseLoader)

        class PlainMarkingLoader(base):
            def resolve(self, kind, value, implicit):
                if kind is yaml.ScalarNode and implicit[0]:
                    return _PLAIN_TAG
                return super().resolve(kind, value, implicit)

        _loader = PlainMarkingLoader
    return _loader


def yaml_text_to_json(text: str) -> str | None:
    """First document of a YAML text as JSON object text, None when it is no valid mapping."""
    return _parsed(text)[0]


def yaml_batch_errors(texts: pa.Array) -> pa.Array:
    """Why each text gives no fields; null for one that does."""
    return pa.array([None if t is None else _parsed(t)[1] for t in texts.to_pylist()], pa.string())


def _parsed(text: str) -> tuple[str | None, str | None]:
    """JSON object text, or else the reason why there is none."""
    loader_class = _loader_class()
    try:
        loader = loader_class(text)
        try:
            node = loader.get_node() if loader.check_node() else None
        finally:
            loader.dispose()
        if node is None or (isinstance(node, yaml.ScalarNode) and _scalar(node) == "null"):
            return "{}", None
        if not isinstance(node, yaml.MappingNode):
            return None, "no mapping"
        return _json(node, [], set(), [_MAX_REPEATED]), None
    except RecursionError:
        return None, "nested too deep"
    except yaml.YAMLError as error:
        return None, "invalid YAML: " + " ".join(str(getattr(error, "problem", None) or error).split())
    except ValueError as error:
        return None, " ".join(str(error).split())


def _json(node, parents, seen, budget):
    budget[0] -= id(node) in seen
    seen.add(id(node))
    if budget[0] < 0 or any(node is p for p in parents):
        raise ValueError("aliases expand without bound")
    if isinstance(node, yaml.ScalarNode):
        return _scalar(node)
    inside = parents + [node]
    if isinstance(node, yaml.SequenceNode):
        return "[" + ",".join(_json(n, inside, seen, budget) for n in node.value) + "]"
    members = _members(node, inside)
    return "{" + ",".join(f"{json.dumps(k)}:{_json(v, inside, seen, budget)}" for k, v in members.items()) + "}"


def _members(node, parents):
    own, merged = {}, {}
    for key, value in node.value:
        if not isinstance(key, yaml.ScalarNode):
            raise ValueError("only scalars can be keys")
        if key.tag == _PLAIN_TAG and key.value == "<<":
            for source in value.value if isinstance(value, yaml.SequenceNode) else [value]:
                if not isinstance(source, yaml.MappingNode) or any(source is p for p in parents):
                    raise ValueError("only mappings can be merged")
                for k, v in _members(source, parents + [source]).items():
                    merged.setdefault(k, v)
        elif key.value in own:
            raise ValueError("duplicate key")
        else:
            own[key.value] = value
    return {**merged, **own}


def _scalar(node):
    value = node.value
    if node.tag not in (_PLAIN_TAG, "tag:yaml.org,2002:null", "tag:yaml.org,2002:bool",
                        "tag:yaml.org,2002:int", "tag:yaml.org,2002:float"):
        return json.dumps(value)
    if value == "" or re.fullmatch(NULL_WORDS, value):
        return "null"
    if re.fullmatch(TRUE_WORDS, value):
        return "true"
    if re.fullmatch(FALSE_WORDS, value):
        return "false"
    if re.fullmatch(JSON_NUMBER, value):
        return value
    if re.fullmatch(OTHER_NUMBER, value):  # infinities and NaN have no JSON form and stay text
        if value[:2] in ("0x", "0o"):
            return str(int(value, 0))
        if re.fullmatch(r"[-+]?[0-9]+", value):
            return str(int(value))
        if value[-1:] not in "fFnN":
            return repr(float(value))
    return json.dumps(value)
