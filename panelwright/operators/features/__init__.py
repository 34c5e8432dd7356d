from . import catalogue  # noqa: F401
from .base import REGISTRY, Feature, FeatureError, feature  # noqa: F401
