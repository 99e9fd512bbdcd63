"""Row-level column expressions; everything here stays inside whole-stage codegen."""
