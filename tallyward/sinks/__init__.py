"""Reports of an audit."""
