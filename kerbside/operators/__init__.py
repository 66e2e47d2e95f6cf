"""DataFrame to DataFrame operators. All lazy unless a docstring says otherwise."""
