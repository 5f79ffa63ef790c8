"""Tables from first look to model monitoring, as functions from DataFrame to DataFrame."""
