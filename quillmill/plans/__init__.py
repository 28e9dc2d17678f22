"""Plans that chain operators: production of sections, dispatch, search and review; and the registered queries."""
