"""Session helpers, derived views and the registered queries."""
