"""Sources and sinks: relational tables, the fixture binding, CSV, profiles."""
