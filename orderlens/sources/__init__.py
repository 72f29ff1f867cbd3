"""Sources and sinks: order exports, dimension files, registered views and JSON results."""
